"""Variant spellings of the names of people and organisations."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.session import durable, written

# Legal forms, which make no difference.
LEGAL = {
    "inc", "incorporated", "corp", "corporation", "ltd", "limited", "llc", "ag", "gmbh", "mbh", "gesellschaft",
    "sa", "ev", "plc", "co", "company", "kg", "bv", "nv", "oy", "ab", "srl", "spa", "lp", "llp", "pty", "pte",
}
# Leading titles and words that only connect.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "dame", "dra", "sra", "herr", "frau", "phd", "md", "rev", "hon"}
LINKS = {"the", "of", "and", "for", "de", "der", "die", "das", "la", "le", "el"}
# Kinds of body and the usual short forms of each.
KINDS = {
    "systems": "sys", "observatory": "obs", "technologies": "tech", "laboratories": "labs lab", "association": "assn assoc",
    "institute": "inst", "department": "dept", "manufacturing": "mfg", "foundation": "fdn", "publishing": "publ pub",
    "international": "intl", "university": "univ", "society": "soc", "center": "ctr centre", "museum": "mus", "college": "coll",
    "council": "cncl", "agency": "agcy", "academy": "acad", "library": "libr", "hospital": "hosp", "services": "svcs",
    "solutions": "", "industries": "ind", "partners": "", "group": "grp", "holdings": "", "bank": "", "school": "sch",
    "committee": "cttee", "network": "netw", "press": "", "works": "", "union": "", "trust": "", "consulting": "",
}
# Fields of work that stand between the proper name and the kind.
FIELDS = {
    "optics", "geology", "statistics", "linguistics", "acoustics", "robotics", "logistics", "hydrology", "physics", "chemistry",
    "biology", "mathematics", "astronomy", "economics", "genetics", "electronics", "mechanics", "medicine", "history", "law",
}
# Short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha sandy", "anthony": "tony toni", "benjamin": "ben benny", "charles": "chuck charlie", "christopher": "chris kit",
    "dmitri": "dima mitya", "dolores": "lola", "ekaterina": "katya", "elizabeth": "liz beth betty lizzie", "franziska": "franzi",
    "frederick": "fred fritz freddy", "gabriele": "gabi", "guillermo": "memo", "henrietta": "etta hetty", "johannes": "hannes",
    "josephine": "josie", "katherine": "kate kathy", "leonardo": "leo", "margaret": "peggy meg maggie", "michael": "mike mick",
    "nicholas": "nick", "olivia": "liv", "patricia": "trish pat", "rebecca": "becky", "robert": "bob rob bobby", "susanna": "sue susie",
    "theodore": "ted theo", "thomas": "tom tommy", "victoria": "vicky", "william": "bill will billy", "james": "jim", "joseph": "joe",
    "edward": "ed eddie", "richard": "dick rick", "john": "jack", "daniel": "dan danny", "samuel": "sam", "andrew": "andy drew",
    "david": "dave", "matthew": "matt", "stephen": "steve", "catherine": "cathy", "deborah": "debbie", "jennifer": "jenny", "barbara": "barb",
}

_KIND = {short: kind for kind, shorts in KINDS.items() for short in [kind, *shorts.split()]}
_GIVEN = {short: name for name, shorts in NICKNAMES.items() for short in [name, *shorts.split()]}
_WORD = re.compile(r"[^\W_]+(?:[.'’][^\W_]+)*")
_PART = re.compile(r"\(([^()]*)\)")


def plain(text: str) -> str:
    """Lower case without accents."""
    parts = unicodedata.normalize("NFKD", text)
    return "".join(c for c in parts if not unicodedata.combining(c)).casefold()


def _one_edit(word: str) -> set[str]:
    """The word and the word without each one of its letters."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _near(lexicon: dict[str, str]) -> dict[str, str]:
    """Where a word with one slip leads, for the long words of a lexicon; ambiguous slips lead nowhere."""
    out: dict[str, str] = {}
    for word, name in lexicon.items():
        if len(word) > 5:
            for key in _one_edit(word):
                out[key] = "" if out.get(key, name) != name else name
    return out


class Lexicon:
    """Kinds of body and given names with their short forms: the fixed ones, and those learned from a corpus."""

    def __init__(self, kinds: dict[str, str] | None = None, given: dict[str, str] | None = None):
        self.kind = _KIND | (kinds or {})
        self.given = _GIVEN | (given or {})
        self.near_kind, self.near_given = _near(self.kind), _near(self.given)

    def kind_of(self, word: str) -> str | None:
        return _look(word, self.kind, self.near_kind)

    def given_of(self, word: str) -> str | None:
        return _look(word, self.given, self.near_given)


def _look(word: str, exact: dict[str, str], near: dict[str, str]) -> str | None:
    """The lexicon's name for a word that may have one slip."""
    if word in exact:
        return exact[word]
    if len(word) < 5:
        return None
    found = {near[k] for k in _one_edit(word) if near.get(k)}
    return found.pop() if len(found) == 1 else None


def _split(text: str, slug: bool, lexicon: Lexicon) -> tuple[list[str], int]:
    """Words of one spelling without titles and connecting words, given name first; how many words a surname before a comma has."""
    text = plain(text)
    if slug:
        text = re.sub(r"-\d+$", "", text)
        words = [w for w in text.split("-") if w]
        comma = 0
    else:
        inner = _PART.search(text)
        if inner:  # an acronym before or inside brackets
            outer = _PART.sub(" ", text)
            text = inner.group(1) if len(inner.group(1)) > len(outer.strip()) else outer
        text = re.split(r"\s+[–—|]\s+", text)[0]
        # s.a., e.v., l.l.c. become one word, the initials a. b. stay two
        text = re.sub(r"\b(l\.l\.c|s\.a|e\.v|s\.r\.l|s\.p\.a)\b\.?", lambda m: m.group(1).replace(".", ""), text)
        comma = int("," in text)
        last, _, first = text.partition(",")
        words = _WORD.findall((first + " " + last) if comma and first.strip() else text)
        words = [p for w in words for p in w.replace("’", "").replace("'", "").split(".") if p]
        if comma and first.strip():
            comma = len(_WORD.findall(last)) if not any(lexicon.kind_of(w) or w in LEGAL for w in words) else 0
    words = [w for w in words if w not in LINKS and w not in TITLES]
    joined = []
    for w in words:  # slugs cut l.l.c., s.a. and e.v. into letters
        if slug and joined and (joined[-1], w) in (("s", "a"), ("e", "v"), ("ll", "c"), ("l", "l")):
            joined[-1] += w
        else:
            joined.append(w)
    return joined, comma


FIXED = Lexicon()


def parse(text: str, slug: bool = False, lexicon: Lexicon = FIXED) -> tuple[str, str, str, str, str] | None:
    """(class, proper name, given name or kind, middle initial or field, initial or legal) of one spelling.

    class is ``person`` or ``body``. Null where nothing that names anything is left.
    """
    words, comma = _split(text, slug, lexicon)
    kinds = [k for w in words if (k := lexicon.kind_of(w))]
    legal = any(w in LEGAL for w in words)
    fields = [w for w in words if w in FIELDS]
    if kinds or legal or fields:
        rest = [w for w in words if w not in LEGAL and w not in FIELDS and not lexicon.kind_of(w) and w != "house"]
        proper = "".join(rest)
        return ("body", proper, kinds[0] if kinds else "", fields[0] if fields else "", "") if len(proper) > 2 else None
    words = [w for w in words if not w.isdigit()]
    if not words:
        return None
    given_at = next((i for i, w in enumerate(words) if len(w) > 1 and lexicon.given_of(w)), None)
    long = [i for i, w in enumerate(words) if len(w) > 1 and i != given_at]
    if comma:
        long = [i for i in range(len(words) - comma, len(words)) if len(words[i]) > 1]
        if given_at in long:
            given_at = None
    if given_at is None and len(long) > 1 and not comma:
        # an unknown given name, or a surname cut in two after an initial
        if len(words[0]) > 1:
            given_at, long = long[0], long[1:]
    if given_at is None and comma:
        given_at = next((i for i, w in enumerate(words) if len(w) > 1 and i not in long), None)
    proper = "".join(words[i] for i in long)
    if len(proper) < 3:
        return None
    given = "" if given_at is None else lexicon.given_of(words[given_at]) or words[given_at]
    initials = [w for i, w in enumerate(words) if len(w) == 1]
    if given:
        return "person", proper, given, initials[0] if initials else "", given[0]
    return "person", proper, "", initials[1] if len(initials) > 1 else "", initials[0] if initials else ""


# --- words learned from the corpus -------------------------------------------------------

LEAST_NAMES = 3  # in how many names a word must be seen to be learned
LIKELY = 0.5  # how likely a short form must stand for a long one, among the names it occurs with
SURE = 3.0  # by how many standard deviations names in common must exceed those that chance gives

_PAIRS = "array<struct<first:string,last:string,body:boolean>>"


def _outer_words(titles: pd.Series, slugs: pd.Series) -> pd.Series:
    """First and last word of each spelling, legal forms and initials aside, and whether it has a legal form. Words in lexicons come as they are."""
    out = []
    for title, slug in zip(titles, slugs, strict=True):
        found = []
        for text, is_slug in ((title, False), (slug, True)):
            if not isinstance(text, str):
                continue
            words, comma = _split(text, is_slug, FIXED)
            long = [w for w in words if len(w) > 1 and w not in LEGAL and not w.isdigit()]
            if len(long) == 2 or (len(long) > 2 and not comma):
                found.append({"first": long[0], "last": long[-1], "body": any(w in LEGAL for w in words)})
        out.append(found)
    return pd.Series(out)


def learn_words(entities: DataFrame) -> Lexicon:
    """Kinds of body, their short forms and short given names that the fixed lists lack, from the corpus.

    A kind is a word that follows LEAST_NAMES different names before a legal
    form, and LIKELY or more of all its names. That a short form stands for a
    kind, or a nickname for a given name, is told by their company: it occurs
    with LEAST_NAMES names, and its likelihood, the share of its names that also
    occur with the long form, is LIKELY or more, beyond what chance gives; of
    several the one furthest beyond chance is meant. A name with many partners
    has any given word among them by chance, so it weighs little, but none is
    left out. Short forms of kinds are also subsequences with the same first
    letter. What is collected are the learned words, which grow with the
    vocabulary of kinds and given names.
    """
    rows = entities.select(F.explode(F.pandas_udf(_outer_words, _PAIRS)("title", "slug")).alias("s")).select("s.*")
    pairs = durable(rows.groupBy("first", "last").agg(F.max("body").alias("body")))
    known = [w for w in (*_KIND, *FIELDS, *LEGAL, *TITLES)]
    # a name after its kind isn't one: a kind's names are followed by few other words
    after = pairs.where(~F.col("first").isin(known) & (F.length("last") > 3)).groupBy("last").agg(F.count_if("body").alias("names"), F.count("*").alias("of"))
    after = after.where((F.col("names") >= LEAST_NAMES) & (F.col("names") >= LIKELY * F.col("of")))
    kinds = {r["last"]: r["last"] for r in after.collect() if FIXED.kind_of(r["last"]) is None and r["last"] not in known}

    def short_forms(name: str, word: str, long_: list[str] | None, spare: list[str]) -> list[tuple[str, str]]:
        """(short, long) words in one role beside the same names.

        A short form shares a given part of its names, so the long one occurs with
        one of all its names but that part less one: candidates come from those with
        the fewest partners, which loses none, and are counted over all.
        """
        said = pairs.where(~F.col(name).isin(known)).select(F.col(name).alias("name"), F.col(word).alias("word"))
        of = said.groupBy("word").agg(F.count("*").alias("names"))
        said = durable(said.join(said.groupBy("name").agg(F.count("*").alias("k")), "name").join(of, "word"))
        total = said.count()
        a = said.where((F.col("names") >= LEAST_NAMES) & ~F.col("word").isin(spare)).select("name", F.col("word").alias("a"), F.col("names").alias("na"), "k")
        b = said.select("name", F.col("word").alias("b"), F.col("names").alias("nb"))
        beside = "a <> b and (nb > na or (nb = na and b < a))"
        if long_ is not None:
            b = b.where(F.col("b").isin(long_))
            beside += " and substr(a, 1, 1) = substr(b, 1, 1) and length(a) < length(b) and b rlike array_join(split(a, ''), '.*')"
        need = F.greatest(F.lit(LEAST_NAMES), F.ceil(LIKELY * F.col("na")))
        rank = F.row_number().over(Window.partitionBy("a").orderBy("k", "name"))
        rare = a.withColumn("_rank", rank).where(F.col("_rank") <= F.col("na") - need + 1)
        near = rare.join(b, "name").where(beside).select("a", "b", "na", "nb").distinct()
        shared = near.join(a.select("a", "name"), "a").join(b.select("b", "name"), ["b", "name"])
        both = shared.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both")).where(F.col("both") >= need)
        partners = a.groupBy("a", "k").agg(F.count("*").alias("n")).groupBy("a").agg(F.collect_list(F.struct("k", "n")).alias("partners"))
        chance = F.aggregate("partners", F.lit(0.0), lambda acc, s: acc + s["n"] * F.least(F.lit(1.0), F.col("nb") * (s["k"] - 1) / total))
        judged = both.join(partners, "a").withColumn("_chance", chance).withColumn("_beyond", F.col("both") - F.col("_chance"))
        judged = judged.where(F.col("_beyond") >= LIKELY * (F.col("na") - F.col("_chance")))
        judged = judged.where(F.col("_beyond") >= SURE * F.sqrt(F.col("_chance") * (1 - F.col("_chance") / F.col("na"))))
        best = judged.groupBy("a").agg(F.max_by("b", F.struct("_beyond", "nb", "b")).alias("b"))
        return [(r["a"], r["b"]) for r in best.orderBy("a").collect()]

    every = {**_KIND, **kinds}
    for short, long in short_forms("first", "last", list(every), known):
        kinds[short] = every[long]
    given = dict(short_forms("last", "first", None, [*known, *_GIVEN, *kinds]))
    given = {short: long for short, long in given.items() if FIXED.given_of(short) is None}
    resolved = {short: _GIVEN.get(long, given.get(long, long)) for short, long in given.items()}
    return Lexicon(kinds, resolved)


# --- linking ----------------------------------------------------------------------------

SLIP = 0.05  # chance that a typed name has one slip
LETTERS = 12.0  # how many letters could well follow another in a new name


_SAID = "array<struct<kind:string,proper:string,first:string,second:string,initial:string>>"


def _spellings(lexicon: Lexicon):
    """What a row's title and slug say; a title in another script than Latin is a name as a whole."""

    def read(titles: pd.Series, slugs: pd.Series) -> pd.Series:
        out = []
        for title, slug in zip(titles, slugs, strict=True):
            said = [None, parse(slug, True, lexicon) if isinstance(slug, str) else None]
            if isinstance(title, str):
                if not any("\u0370" <= c <= "\uffff" and c.isalpha() and not "\u1e00" <= c <= "\u1eff" for c in title):
                    said[0] = parse(title, False, lexicon)
                else:  # words in any order
                    whole = "".join(sorted(w for w in _WORD.findall(plain(title)) if len(w) > 1 or w > "\u2e7f"))
                    kind, _, *rest = said[1] or ("person", "", "", "", "")
                    said[0] = (kind, whole, *rest) if len(whole) > 1 else None
            if said[0] and said[1] and said[0][0] != said[1][0]:
                said[1] = None
            out.append([dict(zip(("kind", "proper", "first", "second", "initial"), s, strict=True)) for s in said if s])
        return pd.Series(out)

    return read


def _slips(a: Column, b: Column) -> Column:
    """Slips that turn one spelling into the other; two swapped letters are one slip."""
    far = F.levenshtein(a, b)
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    return F.when((far == 2) & (letters(a) == letters(b)), 1).otherwise(far)


def attach_spellings(forms: DataFrame) -> DataFrame:
    """Attach each spelling to the one it most probably stands for: (kind, form, canonical).

    forms: (kind, form, n), one row a spelling with how often it occurs. Only
    spellings that are attached come out. A noisy channel: the posterior of a
    candidate is its share of all names times the chance of the slips that lead
    from it to the spelling; against it stands the chance that the spelling is a
    name of its own, which falls with its length. Candidates are more frequent
    spellings (on a tie, smaller ones) within one slip, found by joining on the
    spellings with one letter left out, so each has as many keys as letters.
    """
    keys = F.concat(
        F.array("form"),
        F.transform(F.sequence(F.lit(1), F.length("form")), lambda i: F.concat(F.substring(F.col("form"), F.lit(1), i - 1), F.substring(F.col("form"), i + 1, F.length("form")))),
    )
    keyed = forms.where(F.length("form") > 3).select("kind", "form", "n", F.explode(F.array_distinct(keys)).alias("_key"))
    v, c = keyed.alias("v"), keyed.alias("c")
    more = (F.col("c.n") > F.col("v.n")) | ((F.col("c.n") == F.col("v.n")) & (F.col("c.form") < F.col("v.form")))
    pairs = (
        v.join(c, (F.col("v.kind") == F.col("c.kind")) & (F.col("v._key") == F.col("c._key")) & more)
        .select(F.col("v.kind").alias("kind"), F.col("v.form").alias("form"), F.col("c.form").alias("canonical"), F.col("c.n").alias("n"))
        .distinct()
    )
    total = forms.groupBy("kind").agg(F.sum("n").alias("_all"))
    size = F.length("form").cast("double")
    slips = _slips(F.col("form"), F.col("canonical"))
    scored = (
        pairs.join(F.broadcast(total), "kind")  # two kinds of names, so two rows
        .withColumn("_score", F.log(F.col("n") / F.col("_all")) + slips * F.log(F.lit(SLIP) / (26 * size)))
        .where(F.col("_score") > -size * F.log(F.lit(LETTERS)))
    )
    return scored.groupBy("kind", "form").agg(F.max_by("canonical", F.struct("_score", "canonical")).alias("canonical"))


def _components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, root) for the nodes of undirected edges (a, b); root is the least node of the component.

    Roots halve the way in each round, so rounds grow with the logarithm of the
    longest chain; it is an error if ``most`` aren't enough.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("root"))
    for _ in range(most):
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("_r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_r").alias("_r"))
        step = roots.join(near, "node").select("node", "root", F.least("root", "_r").alias("_new"))
        # jump: the root of the root
        jump = roots.select(F.col("node").alias("_new"), F.col("root").alias("_far"))
        new = written(step.join(jump, "_new", "left").select("node", "root", F.least("_new", F.coalesce("_far", "_new")).alias("_new")))
        changed = new.where("root <> _new").limit(1).count()
        roots = new.select("node", F.col("_new").alias("root"))
        if not changed:
            return roots
    raise RuntimeError(f"components still change after {most} rounds")


def same_names(entities: DataFrame) -> DataFrame:
    """One row per entity that can be read: (entity_id, name_key); equal keys mean one person or organisation.

    entities: (entity_id, title, slug); other columns are ignored. Repeated
    rows count once; rows with a null entity_id, or of which neither title nor
    slug names anything, don't come out.

    Title and slug are two spellings of one name. Kinds of body, short forms
    and nicknames beyond the fixed lists are learned first (learn_words); a
    title in another script than Latin stands for its words in any order. Each
    spelling is read into a proper
    name and what goes with it: for people the given name (nicknames resolved)
    and initials, for organisations field and kind of body; leading titles and
    legal forms are dropped. Spellings of proper names are attached by
    attach_spellings; the two spellings of a row belong together in any case.
    Then people of one surname are told apart by given name, where an initial
    stands for the most frequent given name that begins with it; organisations
    by field and kind, where a missing kind stands for the most frequent one.
    """
    rows = entities.where(F.col("entity_id").isNotNull()).groupBy("entity_id", "title", "slug").agg(F.count("*").alias("_n"))
    lexicon = learn_words(rows)
    said = durable(rows.select("entity_id", F.explode(F.pandas_udf(_spellings(lexicon), _SAID)("title", "slug")).alias("s")).select("entity_id", "s.*").distinct())
    forms = said.groupBy("kind", F.col("proper").alias("form")).agg(F.countDistinct("entity_id").alias("n"))
    name = lambda kind, form: F.concat_ws(":", kind, form)
    attached = attach_spellings(forms).select(name("kind", "form").alias("a"), name("kind", "canonical").alias("b"))
    own = said.groupBy("entity_id", "kind").agg(F.min("proper").alias("p"), F.max("proper").alias("q")).where("p <> q")
    roots = _components(attached.unionByName(own.select(name("kind", "p").alias("a"), name("kind", "q").alias("b"))))
    told = said.withColumn("node", name("kind", "proper")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # one row an entity: the fuller of what its spellings say
    one = told.groupBy("entity_id", "kind").agg(
        F.min("root").alias("root"), F.max("first").alias("first"), F.max("second").alias("second"), F.max("initial").alias("initial")
    )
    group = F.when(F.col("kind") == "body", F.concat_ws("/", "root", "second")).otherwise(F.col("root"))
    one = durable(one.withColumn("group", group))
    # given names with slips stand for a more frequent one of the same surname
    firsts = one.where("first <> ''").groupBy("kind", "group", "first").agg(F.count("*").alias("n"))
    x, y = firsts.where("kind = 'person'").alias("x"), firsts.alias("y")
    slip = (
        x.join(y, (F.col("x.group") == F.col("y.group")) & (F.col("x.first") != F.col("y.first")) & (F.substring("x.first", 1, 1) == F.substring("y.first", 1, 1)))
        .where((F.length("x.first") > 4) & (_slips(F.col("x.first"), F.col("y.first")) <= 2))
        .where((F.col("y.n") > F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.first") < F.col("x.first"))))
        .groupBy(F.col("x.group").alias("group"), F.col("x.first").alias("first"))
        .agg(F.max_by("y.first", F.struct("y.n", "y.first")).alias("meant"))
    )
    firsts = firsts.join(slip, ["group", "first"], "left").select("kind", "group", F.coalesce("meant", "first").alias("first"), "n")
    by_initial = firsts.where("kind = 'person'").groupBy("group", F.substring("first", 1, 1).alias("initial")).agg(F.max_by("first", F.struct("n", "first")).alias("guess"))
    by_group = firsts.where("kind = 'body'").groupBy("group").agg(F.max_by("first", F.struct("n", "first")).alias("kind_guess"))
    full = (
        one.join(slip, ["group", "first"], "left").join(by_initial, ["group", "initial"], "left").join(by_group, "group", "left")
        .withColumn("guess", F.when(F.col("kind") == "body", F.col("kind_guess")).otherwise(F.col("guess")))
        .withColumn("first", F.coalesce("meant", F.when(F.col("first") != "", F.col("first")), "guess", F.concat(F.lit("?"), "initial")))
    )
    return full.groupBy("entity_id").agg(F.min(F.concat_ws("/", "group", "first")).alias("name_key"))


def name_classes(entities: DataFrame) -> DataFrame:
    """One row an entity that can be read: (entity_id, class_id, members); class_id is the smallest id of its name."""
    keys = same_names(entities)
    classes = keys.groupBy("name_key").agg(F.min("entity_id").alias("class_id"), F.count("*").alias("members"))
    return keys.join(classes, "name_key").select("entity_id", "class_id", "members")


def same_name_pairs(entities: DataFrame) -> DataFrame:
    """All pairs of entities of one name: (entity_id_a, entity_id_b), a < b. Each pair is asked for, so each is written."""
    keys = same_names(entities)
    a = keys.select("name_key", F.col("entity_id").alias("entity_id_a"))
    b = keys.select("name_key", F.col("entity_id").alias("entity_id_b"))
    return a.join(b, "name_key").where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")
