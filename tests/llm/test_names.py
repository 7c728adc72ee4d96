import pytest
from pyspark.sql import functions as F

from corpusmith.llm import names as N

SCHEMA = "entity_id long, title string, slug string, name_key int"


@pytest.mark.parametrize(
    ("text", "slug", "out"),
    [
        ("Rasotenis, Katherine J.", False, ("person", "rasotenis", "katherine", "j", "k")),
        ("Prof. Dr. Leo M. Nobupatrin", False, ("person", "nobupatrin", "leonardo", "m", "l")),
        ("K. Zalimegu", False, ("person", "zalimegu", "", "", "k")),
        ("nobupatrin-leonardo-m-4", True, ("person", "nobupatrin", "leonardo", "m", "l")),
        ("Laboratories of Statistics Zakovusen S.A.", False, ("body", "zakovusen", "laboratories", "statistics", "")),
        ("Sotr Avimor Optics Intl. Limited", False, ("body", "sotravimor", "international", "optics", "")),
        ("TA (Thekebodros Association)", False, ("body", "thekebodros", "association", "", "")),
        ("Rifebukis Manufacturing – RM", False, ("body", "rifebukis", "manufacturing", "", "")),
        ("zakovusen-statistics-laboratories-s-a", True, ("body", "zakovusen", "laboratories", "statistics", "")),
        ("", False, None), ("Dr.", False, None), ("—", False, None), ("12", True, None),
    ],
)
def test_parse(text, slug, out):
    assert N.parse(text, slug) == out


def groups(spark, rows):
    out = {}
    for r in N.same_names(spark.createDataFrame(rows, SCHEMA)).collect():
        out.setdefault(r["name_key"], set()).add(r["entity_id"])
    return {frozenset(g) for g in out.values()}


def test_variants_meet_and_others_dont(spark):
    rows = [
        (1, "Katherine J. Rasotenis", "katherine-j-rasotenis", 0), (2, "RASOTENIS, KATE", "rasotenis-kate", 0), (3, "K. Rasotenis", "k-rasotenis", 0),
        (4, "Katherine Rasotenes", "katherine-rasotenes", 0), (5, "Катерине Расотенис", "katherine-rasotenis", 0), (6, "Victoria Rasotenis", "victoria-rasotenis", 0),
        (1, "Katherine J. Rasotenis", "katherine-j-rasotenis", 9),
        (10, "Zakovusen Optics Laboratories", "zakovusen-optics-laboratories", 0), (11, "The Zakovusen Optics Labs GmbH", "the-zakovusen-optics-labs-gmbh", 0),
        (12, "Zakovusen Optics Ltd.", "zakovusen-optics", 0), (13, "Zakovusen University", "zakovusen-university", 0), (14, "Zakvousen Optics Laboratories", "zakvousen-optics-laboratories", 0),
        (20, None, None, 0), (None, "Anna Fuba", "anna-fuba", 0), (21, None, "robert-dimolol", 0), (22, "Bob Dimolol", None, 0), (23, "", "", 0),
    ]
    assert groups(spark, rows) == {frozenset(g) for g in ({1, 2, 3, 4, 5}, {6}, {10, 11, 12, 14}, {13}, {21, 22})}
    pairs = [tuple(r) for r in N.same_name_pairs(spark.createDataFrame(rows, SCHEMA)).orderBy("entity_id_a", "entity_id_b").collect()]
    assert len(pairs) == len(set(pairs)) == 10 + 6 + 1 and all(a < b for a, b in pairs)


def test_empty(spark):
    assert N.same_name_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_attachment_is_the_posterior(spark):
    """A rare long spelling one slip from a frequent one is attached; short and distant ones stay."""
    forms = [("person", "rasotenis", 40), ("person", "rasotnis", 1), ("person", "rasotenes", 2), ("person", "ratosenik", 1), ("person", "lima", 3), ("person", "lina", 2)]
    filler = [("person", f"filler{chr(97 + i)}{chr(97 + j)}name", 2) for i in range(20) for j in range(0, 20, 3)]
    out = {r["form"]: r["canonical"] for r in N.attach_spellings(spark.createDataFrame(forms + filler, "kind string, form string, n long")).collect()}
    assert out["rasotnis"] == out["rasotenes"] == "rasotenis"
    assert "ratosenik" not in out and "lina" not in out and "rasotenis" not in out


def test_slips_count_a_swap_once(spark):
    df = spark.createDataFrame([("abcdef", "abdcef", 1), ("abcdef", "abcde", 1), ("abcdef", "xbcdey", 2), ("abc", "abc", 0)], "a string, b string, n int")
    assert df.where(N._slips(F.col("a"), F.col("b")) != F.col("n")).count() == 0


def test_components(spark):
    edges = [("d", "e"), ("a", "b"), ("b", "c"), ("c", "z"), ("x", "y"), ("q", "q")]
    out = {r["node"]: r["root"] for r in N._components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert out == {"a": "a", "b": "a", "c": "a", "z": "a", "d": "d", "e": "d", "x": "x", "y": "x"}


def test_words_nobody_listed(spark):
    """Kinds, their short forms, nicknames and scripts that no list has: pairs against those that are meant."""
    import itertools
    import random

    rnd = random.Random(4)
    syllables = [a + b for a in "bdgklmnprstvz" for b in "aeiou"]
    word = lambda n: "".join(rnd.choice(syllables) for _ in range(n))
    kinds = {"airlines": "arln", "brewery": "brwy", "shipyard": "shpyd", "orchestra": "orch"}
    people = {"zebulon": "zeb", "philippa": "pip", "bartholomew": "barty", "wilhelmina": "mina"}
    legal = ["Inc.", "GmbH", "Ltd.", "S.A.", ""]
    rows, meant, number = [], {}, 0

    def add(name, title, slug=None):
        nonlocal number
        number += 1
        rows.append((number, title, slug or title.lower().replace(".", "").replace(",", "").replace(" ", "-"), 0))
        meant[number] = name

    for i in range(40):
        proper = word(4)
        kind, short = list(kinds.items())[i % 4]
        other = list(kinds)[(i + 1) % 4]
        for k in (kind, kind, short):
            add((proper, kind), f"{proper.title()} {k.title()} {rnd.choice(legal)}".strip())
        add((proper, kind), f"{proper.title()} {kind.title()} Inc.")
        if i % 3 == 0:
            add((proper, other), f"{proper.title()} {other.title()} GmbH")
    for i in range(60):
        last = word(4)
        first, nick = list(people.items())[i % 4]
        other = list(people)[(i + 1) % 4]
        add((last, first), f"{first.title()} {last.title()}")
        add((last, first), f"{last.title()}, {nick.title()}", f"{nick}-{last}")
        add((last, first), f"Dr. {nick.title()} {last.title()}")
        if i % 3 == 0:
            add((last, other), f"{other.title()} {last.title()}")
    for i in range(20):
        last, first = word(4), rnd.choice(list(people))
        cyrillic = "".join(chr(0x430 + ord(c) - 97) for c in last)
        add((last, first), f"{first.title()} {last.title()}")
        add((last, first), f"Зебулон {cyrillic.title()}", f"{first}-{last}")
        add((last, first), f"{cyrillic.title()}, Зебулон", None if i % 2 else f"{first}-{last}")
        rows[-1] = (*rows[-1][:2], None, 0) if i % 2 else rows[-1]
    want = {p for p in itertools.combinations(sorted(meant), 2) if meant[p[0]] == meant[p[1]]}
    got = {tuple(r) for r in N.same_name_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9
    lexicon = N.learn_words(spark.createDataFrame(rows, SCHEMA))
    assert lexicon.kind["arln"] == "airlines" and lexicon.given["barty"] == "bartholomew" and lexicon.given_of("zeb") == "zebulon"


def test_classes_have_every_member(spark):
    rows = [(3, "Anna Fubatero", "anna-fubatero", 0), (1, "Fubatero, Anna", None, 0), (2, "Karl Fubatero", None, 0), (3, "Anna Fubatero", "anna-fubatero", 0)]
    out = {tuple(r) for r in N.name_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {(1, 1, 2), (3, 1, 2), (2, 2, 1)}


def test_names_with_many_partners_count(spark):
    """Surnames of 25 given names each: a nickname is learned from them, to the name it goes with and not to one that stands beside everybody."""
    syllables = [a + b for a in "bdgklmnprst" for b in "aeiou"]
    word = lambda i: syllables[i % 55] + syllables[i * 7 % 53] + syllables[i // 55 % 55] + "ter"
    rows = []
    for i in range(60):
        firsts = ["osgurd", *(word(400 + i * 23 + j) for j in range(22))]
        firsts += ["zebulon", "zeb"] if i % 3 == 0 else ["zebulon" if i % 6 == 1 else word(2000 + 2 * i), word(2001 + 2 * i)]
        rows += [(len(rows) + j, f"{first.title()} {word(i).title()}", None, 0) for j, first in enumerate(firsts)]
    assert N.learn_words(spark.createDataFrame(rows, SCHEMA)).given.get("zeb") == "zebulon"


def test_rare_words_are_learned_at_any_size(spark):
    """A kind of four names is learned beside 60,000 other spellings, and a frequent surname of people and firms stays a surname."""
    rows = [(i, f"{p} Brewery Inc.", None, 0) for i, p in enumerate(["Takuno", "Relimo", "Sadovi", "Pukelo"])]
    rows += [(10 + i, f"{p} Dimolol {form}".strip(), None, 0) for i, (p, form) in enumerate([("Anna", "Ltd."), ("Karl", "Inc."), ("Otto", "GmbH"), *((f"Q{c}elo", "") for c in "abcdefgh")])]
    more = spark.range(60_000).select((F.col("id") + 100).alias("entity_id"), F.format_string("Nuro%s Valo%s", F.conv("id", 10, 36), F.conv("id", 10, 36)).alias("title"))
    df = spark.createDataFrame(rows, SCHEMA).unionByName(more, allowMissingColumns=True)
    kinds = N.learn_words(df).kind
    assert kinds.get("brewery") == "brewery" and "dimolol" not in kinds
