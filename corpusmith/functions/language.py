"""Language of a text by script and by words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points of each script and the language it stands for, in the order ties are settled.
SCRIPTS = {
    "Chinese": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}",
    "Japanese": r"\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF65}-\x{FF9F}",
    "Korean": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}",
    "Arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "Hebrew": r"\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}",
    "Thai": r"\x{0E00}-\x{0E7F}",
    "Hindi": r"\x{0900}-\x{097F}",
    "Bengali": r"\x{0980}-\x{09FF}",
    "Tamil": r"\x{0B80}-\x{0BFF}",
    "Telugu": r"\x{0C00}-\x{0C7F}",
    "Kannada": r"\x{0C80}-\x{0CFF}",
    "Malayalam": r"\x{0D00}-\x{0D7F}",
    "Gujarati": r"\x{0A80}-\x{0AFF}",
    "Punjabi": r"\x{0A00}-\x{0A7F}",
    "Burmese": r"\x{1000}-\x{109F}",
    "Khmer": r"\x{1780}-\x{17FF}",
    "Lao": r"\x{0E80}-\x{0EFF}",
    "Georgian": r"\x{10A0}-\x{10FF}\x{2D00}-\x{2D2F}",
    "Armenian": r"\x{0530}-\x{058F}",
    "Amharic": r"\x{1200}-\x{137F}",
    "Tibetan": r"\x{0F00}-\x{0FFF}",
    "Sinhala": r"\x{0D80}-\x{0DFF}",
    "Russian": r"\x{0400}-\x{052F}",
    "Greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}",
}
# For each Latin-script language, in the order tried, letters of which one must occur (if any) and words of which one must (if any).
LATIN = [
    ("Vietnamese", "ảạắằẳẵặấầẩẫậđẻẽẹếềểễệỉĩịỏọốồổỗộơớờởỡợủũụưứừửữựỷỹỵ", []),
    ("Turkish", "ğış", ["bir", "ve", "için", "ile", "bu", "da", "de", "değil", "ama"]),
    ("Polish", "ąćęłńóśźż", []),
    ("Czech", "ěšžřďťňů", []),
    ("Romanian", "ăâîșț", ["și", "este", "sau", "care", "pentru"]),
    ("Hungarian", "őű", []),
    ("German", "", ["und", "der", "die", "das", "ist"]),
    ("French", "", ["le", "la", "les", "est", "une", "des"]),
    ("Portuguese", "ãõç", ["o", "a", "os", "as", "de", "do", "da", "é", "em", "um", "uma", "não", "que"]),
    ("Spanish", "", ["el", "los", "las", "del", "por"]),
    ("Spanish", "ñ¿¡", []),
    ("Italian", "", ["il", "della", "gli", "che", "è"]),
    ("Dutch", "", ["het", "een", "van", "dat"]),
    ("Swedish", "åäö", ["och", "att", "det", "en", "ett", "är", "för", "med"]),
    ("Norwegian", "åæø", ["og", "er", "det", "en", "et", "for", "med", "på"]),
    ("Danish", "åæø", ["og", "er", "det", "en", "et", "til", "med", "af"]),
    ("Finnish", "äö", ["ja", "on", "ei", "se", "että", "tai", "kun", "niin"]),
    ("Indonesian", "", ["yang", "dari", "untuk", "dengan", "adalah"]),
    ("Swahili", "", ["na", "ya", "wa", "ni", "kwa", "katika", "hii", "hiyo"]),
]
# What tells Persian from Arabic, with how much each counts.
PERSIAN_LETTERS = {"پچژگ": 3, "کی": 1}
PERSIAN_WORDS = ["این", "است", "که", "برای", "های", "را", "در", "به", "از", "می", "یک"]
ARABIC_LETTERS = {"كيةىإأؤئ": 1}
ARABIC_WORDS = ["ال", "في", "من", "على", "هذا", "هذه", "إلى", "التي", "الذي", "كان"]

_WORD = "0-9a-z_"


def _odd(word: str) -> str:
    """A word with other than ASCII letters, bounded as \\b bounds it, which knows ASCII only: at such a letter a neighbour that is one."""
    plain = lambda c: c.isascii()
    before = f"(^|[^{_WORD}])" if plain(word[0]) else f"[{_WORD}]"
    after = f"($|[^{_WORD}])" if plain(word[-1]) else f"[{_WORD}]"
    return f"{before}{word}{after}"


def _has_word(lower: Column, tokens: Column, words: list[str]) -> Column:
    """Whether one of the words occurs: ASCII ones among the tokens, which cut the text at everything else."""
    ascii_, odd = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
    test = F.arrays_overlap(tokens, F.array(*map(F.lit, ascii_)))
    return test | lower.rlike("|".join(map(_odd, odd))) if odd else test


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once however often it is looked at."""
    return F.element_at(F.transform(F.array(value), use), 1)


def language_of(text: Column) -> Column:
    """Name of the language: the most frequent script with two characters or more, else Latin rules, else English.

    One kana beside ideographs makes a text Japanese; Arabic script is Persian
    if its letters and words speak for it more than for Arabic, and at least by
    3. Equally frequent scripts are settled by the order of SCRIPTS. Null and
    empty texts are English.
    """
    text = F.coalesce(text, F.lit(""))
    names = list(SCRIPTS)

    def counted(rest: Column) -> Column:
        counts = F.array(*[F.length(F.regexp_replace(rest, f"[^{chars}]+", "")) for chars in SCRIPTS.values()])
        return F.when(F.length(rest) < 2, "").otherwise(_bound(counts, lambda n: _by_script(n, names)))

    # what no script counts (ASCII, Latin letters, punctuation) is dropped once before scripts are counted
    other = F.regexp_replace(text, r"[\x00-\x{036F}\x{2000}-\x{2BFF}\x{3000}-\x{303F}\x{FF01}-\x{FF64}]+", "")

    def latin(lower: Column, tokens: Column) -> Column:
        out = None
        for name, letters, words in LATIN:
            tests = ([lower.rlike(f"[{letters}]")] if letters else []) + ([_has_word(lower, tokens, words)] if words else [])
            test = tests[0] if len(tests) == 1 else tests[0] & tests[1]
            out = F.when(test, name) if out is None else out.when(test, name)
        return out.otherwise("English")

    def by_words(lower: Column) -> Column:
        return _bound(F.array_distinct(F.split(lower, f"[^{_WORD}]+")), lambda tokens: latin(lower, tokens))

    def named(script: Column) -> Column:
        return F.when(script == "", _bound(F.lower(text), by_words)).when(script == "Arabic", F.when(_persian(text), "Persian").otherwise("Arabic")).otherwise(script)

    return _bound(_bound(other, counted), named)


def _persian(text: Column) -> Column:
    """Whether letters and words of a text in Arabic script speak for Persian: by at least 3, and more than for Arabic."""
    words = F.split(text, r"[^\p{L}\p{N}]+")

    def score(letters: dict[str, int], known: list[str]) -> Column:
        parts = [F.length(F.regexp_replace(text, f"[^{chars}]+", "")) * weight for chars, weight in letters.items()]
        return sum(parts, F.lit(0)) + 2 * F.size(F.array_intersect(words, F.array(*map(F.lit, known))))

    return (score(PERSIAN_LETTERS, PERSIAN_WORDS) >= 3) & (score(PERSIAN_LETTERS, PERSIAN_WORDS) > score(ARABIC_LETTERS, ARABIC_WORDS))


def _by_script(counts: Column, names: list[str]) -> Column:
    """The language the counts of characters by script speak for, empty if none does."""
    most = F.array_max(counts)
    both = (counts[names.index("Japanese")] > 0) & (counts[names.index("Chinese")] > 0)
    first = F.element_at(F.array(*map(F.lit, names)), F.array_position(counts, most).cast("int"))
    return F.when(both, "Japanese").when(most >= 2, first).otherwise("")
