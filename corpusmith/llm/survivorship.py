"""Best representative of each duplicate group, and the truth of multi-valued fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.session import durable

# What people type where a value is missing, lower-cased.
STAND_INS = [
    "none", "(none)", "null", "todo", "tbd", "unknown", "n/a", "na", "nil", "nan", "undefined", "empty",
    "s/o", "k. a.", "k.a.", "s/d", "无", "無", "なし", "없음", "нет",
]
# English month abbreviations.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

SCALARS = ["title", "description", "content", "created"]
LISTS = ["tags", "sources", "related"]


def trimmed(value: Column) -> Column:
    """The value without white space of any kind around it."""
    return F.regexp_replace(value, r"(?U)^[\s\x{FEFF}\x{200B}]+|[\s\x{FEFF}\x{200B}]+$", "")


# What speaks for or against a value: the name of each witness with how often it is first believed to
# accept a value that says something and one that says nothing. The first two know: what they reject says nothing.
WITNESSES = {
    "word": (0.999999, 0.3),  # it isn't a known stand-in
    "letters": (0.999999, 0.7),  # it has a letter, digit or symbol
    "rare": (0.99, 0.1),  # it doesn't stand on more than a 200th of all members, in several groups
    "own": (0.99, 0.1),  # it doesn't stand in several fields of a 2,000th of all members, in several groups
}
# How many claims those beliefs weigh; from FULL claims on they weigh a fixed share of all, so that rates don't depend on the size.
TRUE_WEIGHT, FALSE_WEIGHT, FULL = 100.0, 10.0, 10_000
PROSE = ["title", "description", "content"]
COMMON, SPREAD, LEAST = 200, 2000, 10


def _local(text: Column) -> Column:
    """What a trimmed value alone shows, in two bits: no known stand-in, not only punctuation. Null shows neither."""
    says = lambda test, bit: F.when(F.coalesce(test, F.lit(False)), bit).otherwise(0)
    return says(text.isNotNull() & ~F.lower(text).isin(STAND_INS), 1) + says(text.rlike(r"[\p{L}\p{N}\p{S}]"), 2)


def _value_key(text: Column) -> Column:
    return F.xxhash64(F.lower(text))


class Values:
    """Which values say something: a latent two-sided quality model of witnesses.

    Every claim (a member fills a field with a value) is true or a stand-in.
    Witnesses accept or reject each value. Two look at the value itself and know
    what is a stand-in; two look at where else in the corpus it stands (prose
    fields only; on the others they abstain). How often these
    two accept a true value (sensitivity) and reject a stand-in (specificity) is
    inferred from all claims by expectation-maximisation, in which the known
    stand-ins and what nobody rejects are given, run until the rates stand still. So a stand-in nobody
    listed is found by being everywhere, and a value stays whatever else its
    record's other members say: several spellings of a title are all true.

    Members that say the same in all fields count once, in their first group, when
    it is asked where a value stands: reports of a group under further ids are
    no evidence of several groups.

    The iterations run over patterns of testimony, at most 20 of them. Values that the
    last two reject are collected as hashes: each stands on a 2,000th of the
    distinct members or more, so there are at most 4 x 2,000.
    """

    def __init__(self, members: DataFrame):
        fields = [*PROSE, "created"]
        told = members.where(F.col("group_id").isNotNull() & F.col("slug").isNotNull())
        keys = [F.when(F.length(trimmed(F.col(c))) > 0, _value_key(trimmed(F.col(c)))).alias(f"_{c}") for c in fields]
        record = F.xxhash64(*SCALARS, *LISTS, "updated", "confidence")
        once = durable(told.select(record.alias("_record"), "group_id", *keys).groupBy("_record").agg(F.min("group_id").alias("group_id"), *[F.min(f"_{c}").alias(f"_{c}") for c in fields]))
        total = once.count()
        said = once.select("group_id", F.explode(F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.col(f"_{c}").alias("key")) for i, c in enumerate(fields)])).alias("s"))
        known = said.where(F.col("s.key").isNotNull()).groupBy("s.key")
        seen = known.agg(F.count("*").alias("n"), F.min("group_id").alias("g"), F.max("group_id").alias("h"), F.bit_or("s.bit").alias("bits"))
        seen = seen.where((F.col("g") != F.col("h")) & (F.col("n") >= max(LEAST, total / SPREAD)))
        rows = seen.select("key", (F.col("n") >= total / COMMON).alias("common"), (F.bit_count("bits") > 1).alias("spread")).collect()
        self.common = [r["key"] for r in rows if r["common"]]
        self.spread = [r["key"] for r in rows if r["spread"]]
        lists = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: F.struct(_local(trimmed(v)).alias("code"))) for c in LISTS]
        alone = F.array(*[F.struct(self.code(F.col(c), c).alias("code")) for c in fields])
        counts = told.select(F.explode(F.concat(alone, *lists)).alias("s")).groupBy("s.code").agg(F.count("*").alias("n")).collect()
        self.quality, self.true = _fit({r["code"]: r["n"] for r in counts})

    def code(self, value: Column, field: str) -> Column:
        """What the witnesses say of a value of a field, in six bits: accepted by word, letters, rare, own; rare and own were asked."""
        text = trimmed(value)
        if field not in PROSE:
            return _local(text)
        key = _value_key(text)
        absent = lambda keys, bit: F.when(key.isin(keys), 0).otherwise(bit) if keys else F.lit(bit)
        return _local(text) + absent(self.common, 4) + absent(self.spread, 8) + F.lit(16)

    def filled(self, value: Column, field: str) -> Column:
        """Whether a value is judged to say something."""
        return F.coalesce(self.code(value, field).isin(self.true), F.lit(False)) if self.true else F.lit(False)

    def list_filled(self, values: Column, field: str) -> Column:
        """Whether any element of a list says something."""
        return F.coalesce(F.exists(values, lambda v: self.filled(v, field)), F.lit(False))


def _fit(counts: dict[int, int]) -> tuple[dict[str, tuple[float, float]], list[int]]:
    """Rates of the witnesses by expectation-maximisation over patterns of testimony, and the patterns judged true (all there can be).

    Claims that a witness of the value itself rejects are stand-ins in every
    round, and claims that no witness rejects are true, which ties the labels to
    what they mean; the rest is inferred. The share of true claims is that among
    the claims about which all are asked.
    """
    asked, alone = range(16, 32), range(4)
    whole = sum(counts.values())
    size = max(1.0, whole / FULL)
    quality = dict(WITNESSES)
    prior = 0.5
    while True:
        post = {p: float(p == 3) for p in alone}
        for p in asked:
            odds = math.log(prior / (1 - prior))
            for i, (sens, fall) in enumerate(quality.values()):
                odds += math.log(sens / fall) if p >> i & 1 else math.log((1 - sens) / (1 - fall))
            post[p] = float(p == 31) if p & 3 != 3 or p == 31 else 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        new = {}
        for i, (name, (sens, fall)) in enumerate(WITNESSES.items()):
            rows = [(counts.get(p, 0), post[p], p >> i & 1) for p in asked]
            true, false = sum(n * t for n, t, _ in rows), sum(n * (1 - t) for n, t, _ in rows)
            new[name] = (
                (sum(n * t for n, t, yes in rows if yes) + size * TRUE_WEIGHT * sens) / (true + size * TRUE_WEIGHT) if i > 1 else sens,
                (sum(n * (1 - t) for n, t, yes in rows if yes) + size * FALSE_WEIGHT * fall) / (false + size * FALSE_WEIGHT),
            )
        claims = sum(counts.get(p, 0) for p in asked)
        next_prior = (sum(counts.get(p, 0) * post[p] for p in asked) + size * 5) / (claims + size * 10)
        moved = max(abs(next_prior - prior), *(abs(x - y) for name in quality for x, y in zip(quality[name], new[name], strict=True)))
        quality, prior = new, next_prior
        if moved < 1e-7:
            return quality, [p for p in (*alone, *asked) if post[p] >= 0.5]


def day_number(value: Column) -> Column:
    """Calendar day as yyyymmdd of a date in any of several notations, else 0 (the earliest)."""
    text = F.lower(trimmed(value))
    number = lambda pattern, group: F.regexp_extract(text, pattern, group)
    iso, dmy = r"^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})(?:$|[t ])", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"
    d_mon, mon_d = r"^(\d{1,2})\.? +([a-z]{3})[a-z]*\.?,? +(\d{4})", r"^([a-z]{3})[a-z]*\.? +(\d{1,2}),? +(\d{4})"
    month = lambda name: F.array_position(F.array(*map(F.lit, MONTHS)), name)

    def join(y: Column, m: Column, d: Column) -> Column:
        return y.try_cast("int") * 10000 + m.try_cast("int") * 100 + d.try_cast("int")

    return F.coalesce(
        F.when(text.rlike(iso), join(number(iso, 1), number(iso, 2), number(iso, 3))),
        F.when(text.rlike(d_mon), join(number(d_mon, 3), month(number(d_mon, 2)), number(d_mon, 1))),
        F.when(text.rlike(mon_d), join(number(mon_d, 3), month(number(mon_d, 1)), number(mon_d, 2))),
        F.when(text.rlike(dmy), join(number(dmy, 3), number(dmy, 2), number(dmy, 1))),
        F.lit(0),
    )


def confidence_rank(value: Column) -> Column:
    """high 3, medium 2, low 1, else 0, whatever the case and spacing."""
    text = F.lower(trimmed(value))
    return F.when(text == "high", 3).when(text == "medium", 2).when(text == "low", 1).otherwise(0)


def best_representatives(members: DataFrame) -> DataFrame:
    """For each group the member that survives, as a whole and field by field.

    Which values are claims at all is decided by the latent quality model of
    Values, over all members. Among the members whose value is judged true the
    documented order chooses: the member with most filled ones of title,
    description, content, created, tags, sources and related, then later
    updated, then higher confidence; a title by confidence, then updated; a
    description by updated, then confidence; a content by length, then updated.

    members: group_id, slug, title, description, content, tags, sources,
    related, created, updated, confidence; further columns are ignored.
    Returns one row a group: group_id and the slugs canonical, title,
    description, content (null where no member has a filled value).

    One aggregation per group, combined on the map side, so that a group with
    a third of all members costs no more than any other. Repeated rows don't
    change it. Rows with a null group_id or slug are dropped; groups with fewer
    than two slugs give nothing. Ties end at the smallest slug.
    """
    values = Values(members)
    filled_count = sum([values.filled(F.col(c), c).cast("int") for c in SCALARS] + [values.list_filled(F.col(c), c).cast("int") for c in LISTS], F.lit(0))
    rows = members.where(F.col("group_id").isNotNull() & F.col("slug").isNotNull()).select(
        "group_id",
        "slug",
        filled_count.alias("n"),
        day_number(F.col("updated")).alias("day"),
        confidence_rank(F.col("confidence")).alias("conf"),
        *[values.filled(F.col(c), c).alias(f"has_{c}") for c in PROSE],
        F.length(trimmed(F.col("content"))).alias("size"),
    )
    orders = {
        "canonical": (F.col("n") > 0, ["n", "day", "conf"]),
        "title": (F.col("has_title"), ["conf", "day"]),
        "description": (F.col("has_description"), ["day", "conf"]),
        "content": (F.col("has_content"), ["size", "day"]),
    }
    # min over negated keys leaves the smallest slug as the last word
    picks = [
        F.min(F.when(has, F.struct(*[(-F.col(c)).alias(c) for c in keys], "slug"))).alias(name)
        for name, (has, keys) in orders.items()
    ]
    groups = rows.groupBy("group_id").agg(F.min("slug").alias("_a"), F.max("slug").alias("_b"), *picks)
    return groups.where(F.col("_a") != F.col("_b")).select("group_id", *[F.col(n)["slug"].alias(n) for n in orders])


def representatives_by_field(members: DataFrame) -> DataFrame:
    """best_representatives as rows (group_id, field, slug); no row where nothing is filled."""
    best = best_representatives(members)
    fields = [c for c in best.columns if c != "group_id"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("slug")) for c in fields]))
    return best.select("group_id", pairs.alias("_p")).select("group_id", "_p.*").where(F.col("slug").isNotNull())


def multi_value_truth(
    members: DataFrame,
    fields: tuple[str, ...] = ("tags", "sources", "related"),
    prior: float = 0.5,
    threshold: float = 0.5,
    settled: float = 1e-3,
    most_rounds: int = 200,
) -> DataFrame:
    """Which values of a group's multi-valued fields are true: (group_id, field, value, support, posterior, kept).

    A latent two-sided quality model. A member that fills a field claims the
    values it lists and denies the group's other values. Members are pooled
    into sources by page type and stated confidence; each source has a
    sensitivity (how often it lists a true value) and a false-positive rate
    (how often it lists a false one), found by expectation-maximisation until
    no rate moves by more than ``settled``; it is an error if that takes more
    than ``most_rounds``. What counts as a value at all is judged by Values.
    Every value whose posterior reaches ``threshold`` is kept, so a field may
    keep many values.

    Work is by fact (group, field, value) with counts per source; facts with
    equal counts share one posterior, so the iterations run over the distinct
    count patterns. The collected parameters are two numbers a source, at most
    ``9 known types + other`` x 4 confidences. Values compare trimmed and
    lower-cased; stand-ins and nulls claim nothing; repeated rows count once.
    Groups with one slug give nothing; where one member of several fills a
    field, its claim alone decides. Empty input gives an empty result.
    """
    values = Values(members)
    known = ["source", "entity", "concept", "comparison", "query", "synthesis", "thesis", "methodology", "finding"]
    kind = F.lower(trimmed(F.col("type")))
    member = members.where(F.col("group_id").isNotNull() & F.col("slug").isNotNull()).select(
        "group_id",
        "slug",
        F.concat_ws(":", F.when(kind.isin(known), kind).otherwise("other"), confidence_rank(F.col("confidence"))).alias("source"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("field"),
                        F.array_distinct(F.transform(F.filter(F.coalesce(F.col(f), F.array().cast("array<string>")), lambda v: values.filled(v, f)), lambda v: F.lower(trimmed(v)))).alias("values"),  # noqa: B023
                    )
                    for f in fields
                ]
            )
        ).alias("_f"),
    )
    # one row per member and field, whatever was repeated
    claims = (
        member.select("group_id", "slug", F.col("_f.field").alias("field"), "source", F.explode("_f.values").alias("value"))
        .groupBy("group_id", "field", "slug", "value")
        .agg(F.max("source").alias("source"))
    )
    listed = claims.groupBy("group_id", "field", "value", "source").agg(F.count("*").alias("n"))
    facts = listed.groupBy("group_id", "field", "value").agg(
        F.sort_array(F.collect_list(F.struct("source", "n"))).alias("yes"), F.sum("n").alias("support")
    )
    voters = (
        claims.select("group_id", "field", "slug", "source").distinct().groupBy("group_id", "field", "source").agg(F.count("*").alias("n"))
        .groupBy("group_id", "field").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("all"))
    )
    # members that fill nothing count here: a field that one of several members fills still has values
    several = member.groupBy("group_id").agg(F.min("slug").alias("_a"), F.max("slug").alias("_b")).where(F.col("_a") != F.col("_b")).select("group_id")
    observed = (
        facts.join(voters, ["group_id", "field"])
        .join(several, "group_id", "left_semi")
        .withColumn("yes", F.map_from_entries("yes"))
        .withColumn(
            "pattern",
            F.transform("all", lambda s: F.struct(s["source"].alias("source"), F.coalesce(F.col("yes")[s["source"]], F.lit(0)).alias("yes"), s["n"].alias("n"))),
        )
        .select("group_id", "field", "value", "support", "pattern")
    )
    patterns = durable(observed.groupBy("pattern").agg(F.count("*").alias("facts")))
    quality: dict[str, tuple[float, float]] = {}

    def posterior(pattern: Column) -> Column:
        def log_odds(s: Column) -> Column:
            sens = F.coalesce(table_sens[s["source"]], F.lit(0.7))
            fall = F.coalesce(table_fall[s["source"]], F.lit(0.2))
            no = s["n"] - s["yes"]
            return s["yes"] * (F.log(sens) - F.log(fall)) + no * (F.log(1 - sens) - F.log(1 - fall))

        empty = F.create_map().cast("map<string,double>")
        table_sens = F.create_map(*[F.lit(x) for k, v in quality.items() for x in (k, v[0])]) if quality else empty
        table_fall = F.create_map(*[F.lit(x) for k, v in quality.items() for x in (k, v[1])]) if quality else empty
        start = F.lit(0.0) + F.log(F.lit(prior)) - F.log(F.lit(1 - prior))
        odds = F.aggregate(pattern, start, lambda acc, s: acc + log_odds(s))
        return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(50.0)), F.lit(-50.0))))

    moved, rounds = 1.0, 0
    while moved > settled:
        if rounds == most_rounds:
            raise RuntimeError(f"rates still move by {moved} after {rounds} rounds")
        rows = (
            patterns.select("facts", posterior(F.col("pattern")).alias("p"), F.explode("pattern").alias("s"))
            .groupBy("s.source")
            .agg(
                F.sum(F.col("facts") * F.col("p") * F.col("s.yes")).alias("tp"),
                F.sum(F.col("facts") * F.col("p") * F.col("s.n")).alias("t"),
                F.sum(F.col("facts") * (1 - F.col("p")) * F.col("s.yes")).alias("fp"),
                F.sum(F.col("facts") * (1 - F.col("p")) * F.col("s.n")).alias("f"),
            )
            .collect()
        )
        # Beta priors keep both rates inside (0, 1): 7 of 10 true values listed, 2 of 10 false ones
        new = {r["source"]: ((r["tp"] + 7) / (r["t"] + 10), (r["fp"] + 2) / (r["f"] + 10)) for r in rows}
        moved = max((abs(x - y) for k, v in new.items() for x, y in zip(v, quality.get(k, (0.7, 0.2)), strict=True)), default=0.0)
        quality, rounds = new, rounds + 1
    out = observed.withColumn("posterior", F.round(posterior(F.col("pattern")), 6))
    return out.select("group_id", "field", "value", "support", "posterior", (F.col("posterior") >= threshold).alias("kept"))
