import pytest
from pyspark.sql import functions as F

from corpusmith.llm import survivorship as S

SCHEMA = (
    "group_id long, slug string, type string, title string, description string, content string, tags array<string>, "
    "sources array<string>, related array<string>, created string, updated string, confidence string, extra int"
)


def row(group, slug, title=None, description=None, content=None, tags=None, created=None, updated=None, confidence=None, sources=None, related=None):
    return (group, slug, "entity", title, description, content, tags, sources, related, created, updated, confidence, 1)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r["group_id"], r["field"]): r["slug"] for r in S.representatives_by_field(df).collect()}


def test_orders_and_ties(spark):
    rows = [
        row(1, "b", "T", "n/a", "short", ["x"], "2024-01-01", "2024-03-01", " HIGH "),
        row(1, "a", "T2", "said", "  much longer content  ", ["-", " "], None, "Mar 2, 2024", "low"),
        row(1, "b", "T", "n/a", "short", ["x"], "2024-01-01", "2024-03-01", " HIGH "),
        row(2, "only", "T", "d", "c"),
        row(2, "only", "T", "d", "c"),
        row(None, "x", "T"),
        row(3, None, "T"),
        row(3, "z", "null", " ", "—"),
        row(3, "y", "???", "TODO", None),
        row(4, "q", "same", "same", "same", confidence="low"),
        row(4, "p", "same", "same", "same", confidence="low"),
    ]
    out = found(spark, rows)
    assert out[1, "title"] == "b" and out[1, "description"] == "a" and out[1, "content"] == "a"
    assert out[1, "canonical"] == "b"  # four filled against three
    assert not any(group in (2, 3, None) for group, _ in out)
    assert {out[4, f] for f in ("canonical", "title", "description", "content")} == {"p"}


def test_empty(spark):
    assert found(spark, []) == {}
    assert S.multi_value_truth(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2024-02-03", 20240203), ("2024/02/03", 20240203), ("20240203", 20240203), ("2024-02-03T04:05:06Z", 20240203), ("3 Feb 2024", 20240203),
        ("Feb 3, 2024", 20240203), ("03.02.2024", 20240203), ("n/a", 0), ("", 0), (None, 0), ("soon", 0),
    ],
)
def test_days(spark, text, day):
    assert spark.createDataFrame([(text,)], "t string").select(S.day_number(F.col("t"))).first()[0] == day


def test_truth_keeps_what_good_sources_say(spark):
    """Members of high confidence list the three true values, those of low confidence add a false one of their own."""
    rows = []
    for group in range(60):
        true = [f"t{group}{c}" for c in "abc"]
        rows += [row(group, f"h{i}", tags=true, confidence="high") for i in range(3)]
        rows += [row(group, f"l{i}", tags=[true[i % 3], f"noise{group}-{i}"], confidence="low") for i in range(3)]
    out = S.multi_value_truth(spark.createDataFrame(rows, SCHEMA)).collect()
    kept = {r["value"] for r in out if r["kept"]}
    assert kept == {r["value"] for r in out if r["value"].startswith("t")}
    assert all(0 <= r["posterior"] <= 1 for r in out)


def test_truth_matches_plain_em(spark):
    """The posteriors equal those of an unpooled expectation-maximisation over single claims."""
    import math
    import random
    from collections import defaultdict

    rnd = random.Random(4)
    rows = []
    for group in range(30):
        for i in range(rnd.randint(1, 5)):
            tags = [v for v in "abcde" if rnd.random() < 0.5] or ["a"]
            rows.append(row(group, f"s{i}", tags=tags, confidence=rnd.choice(["high", "low"])))
    got = {(r["group_id"], r["value"]): r["posterior"] for r in S.multi_value_truth(spark.createDataFrame(rows, SCHEMA)).where("field = 'tags'").collect()}
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(("entity:" + {"high": "3", "low": "1"}[r[11]], set(r[6])))
    facts = {(g, v): [(s, v in tags) for s, tags in m] for g, m in groups.items() if len(m) > 1 for v in set().union(*(t for _, t in m))}
    q, moved = {}, 1.0
    while moved > 0:
        p = {}
        for k, claims in facts.items():
            odds = 0.0
            for s, yes in claims:
                sens, fall = q.get(s, (0.7, 0.2))
                odds += math.log(sens / fall) if yes else math.log((1 - sens) / (1 - fall))
            p[k] = 1 / (1 + math.exp(-odds))
        sums = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
        for k, claims in facts.items():
            for s, yes in claims:
                sums[s][0] += p[k] * yes
                sums[s][1] += p[k]
                sums[s][2] += (1 - p[k]) * yes
                sums[s][3] += 1 - p[k]
        if moved <= 1e-3:
            break
        new = {s: ((a + 7) / (b + 10), (c + 2) / (d + 10)) for s, (a, b, c, d) in sums.items()}
        moved = max(abs(x - y) for s, v in new.items() for x, y in zip(v, q.get(s, (0.7, 0.2)), strict=True))
        q = new
    assert got.keys() == p.keys()
    assert max(abs(got[k] - p[k]) for k in p) < 1e-4


def test_truth_of_a_field_that_one_member_fills(spark):
    rows = [row(1, "a", tags=["x", "y"], confidence="high"), row(1, "b", sources=["s"]), row(2, "a", tags=["z"]), row(2, "a", tags=["z"])]
    rows += [row(9, s, tags=["p"], confidence="high") for s in "ab"]
    out = S.multi_value_truth(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["group_id"], r["field"], r["value"], r["support"], r["kept"]) for r in out} == {
        (1, "tags", "x", 1, True), (1, "tags", "y", 1, True), (1, "sources", "s", 1, True), (9, "tags", "p", 2, True),
    }


def test_stand_ins_nobody_listed_are_found_by_being_everywhere(spark):
    """Half of all titles and descriptions are one odd word; it loses, while values of one group stay, even where others disagree."""
    rows = []
    for group in range(40):
        rows += [row(group, "a", "fill me", "fill me", f"text {group}", confidence="high"), row(group, "b", f"Name {group}", f"About {group}", "fill me", confidence="low")]
    out = found(spark, rows)
    assert all(out[g, "title"] == "b" and out[g, "description"] == "b" and out[g, "content"] == "a" for g in range(40))


def test_quality_of_the_witnesses(spark):
    rows = [row(g, s, f"T {g}{s}" if s == "a" else "n/a", "-" if g % 2 else f"D {g}", f"C {g}{s}") for g in range(50) for s in "ab"]
    values = S.Values(spark.createDataFrame(rows, SCHEMA))
    assert values.quality["word"][0] > 0.99 and values.quality["rare"][1] < 0.3
    assert {p for p in values.true if p >= 16} >= {31} and not any(p & 1 == 0 for p in values.true)


@pytest.mark.parametrize("times", [1, 10, 1000, 100_000])
def test_judgement_doesnt_depend_on_the_size(times):
    """What says something and what doesn't is the same for any number of claims: a known stand-in stays one, a value nobody rejects stays."""
    # testimonies of the given tables and, last, of one without a value that is everywhere
    for counts in (
        {31: 72616, 28: 5087, 1: 31707, 3: 217384, 17: 6597, 29: 6811, 2: 14634, 0: 1721, 18: 20528},
        {31: 852, 28: 63, 1: 395, 3: 2479, 17: 87, 29: 89, 2: 186, 0: 17, 18: 235},
        {31: 37, 1: 22, 3: 104, 29: 8, 2: 7, 30: 12, 0: 1},
    ):
        _, true = S._fit({p: n * times for p, n in counts.items()})
        assert {3, 31} <= set(true) and all(p & 3 == 3 for p in true)


def test_copies_of_groups_change_nothing(spark):
    """A title that a quarter of one group's members share is no stand-in because the group was reported again under other ids."""
    rows = [
        row(group + 1000 * copy, f"{s}{copy}", f"Name {group}", "n/a" if s == "b" else f"About {group} {s}", f"{'Long ' * (s == 'b')}text {group} {s}", confidence="low")
        for group in range(8) for s in "abc" for copy in range(12)
    ]
    out = found(spark, rows)
    assert len(out) == 8 * 12 * 4
    assert all(out[g, "title"] == f"a{g // 1000}" and out[g, "content"] == f"b{g // 1000}" for g, f in out if f == "title")
