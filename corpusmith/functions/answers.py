"""Functions over questions and generated answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmith.functions import text as T

# Whole messages that are greetings, after trailing marks are cut, and what may follow the first ones.
HELLOS = ["hi", "hello", "hey", "yo", "sup", "howdy", "hiya", "heya", "hullo"]
TO_WHOM = ["there", "y'all", "you", "folks", "everyone"]
GOOD_TIMES = ["good morning", "good afternoon", "good evening", "good day", "good night"]
GREETINGS = [
    "what's up", "whats up", "wassup", "whaddup", "greetings",
    "早", "早啊", "早安", "早上好", "中午好", "下午好", "晚上好", "晚安",
    "在吗", "在嗎", "在不在", "有人吗", "有人嗎", "有人在吗", "有人在嗎",
    "こんにちは", "こんばんは", "おはよう", "おはようございます", "やあ", "どうも", "はじめまして",
    "안녕", "안녕하세요", "안녕하십니까",
    "hola", "bonjour", "salut", "coucou", "hallo", "servus", "hej", "hejsan", "ciao", "saluton", "ola", "olá", "privet", "привет",
]
CHINESE_HELLOS = ["你好", "您好", "大家好", "嗨", "哈喽", "哈啰", "哈囉", "哈罗", "喂"]
CHINESE_TIMES = ["早", "早啊", "早安", "早上好", "中午好", "下午好", "晚上好", "晚安"]
PARTICLES = ["啊", "呀", "吖", "呢", "么", "呗", "哦", "哈"]
# Languages that run right to left, and those whose script family isn't latin, which is the default.
RIGHT_TO_LEFT = ["Arabic", "Persian", "Hebrew"]
FAMILIES = {"arabic": ["Arabic", "Persian"], "cjk": ["Chinese", "Traditional Chinese", "Japanese", "Korean"], "other": ["Hebrew"]}


def _greetings() -> list[str]:
    """Every greeting in full."""
    hellos = HELLOS + [f"{h} {w}" for h in HELLOS for w in TO_WHOM]
    return hellos + GOOD_TIMES + GREETINGS + [h + p for h in CHINESE_HELLOS + CHINESE_TIMES for p in ["", *PARTICLES]]


def is_greeting(text: Column, most: int = 20) -> Column:
    """Whether a message is a greeting and nothing else; null isn't."""
    bare = F.lower(F.trim(F.regexp_replace(F.trim(text), r"[\s!！。.?？~,，、;；:：]+$", "")))
    return F.coalesce((F.length(bare) <= most) & bare.isin(_greetings()), F.lit(False))


def text_direction(language: Column) -> Column:
    return F.when(language.isin(RIGHT_TO_LEFT), "rtl").otherwise("ltr")


def script_family(language: Column) -> Column:
    out = None
    for family, names in FAMILIES.items():
        out = F.when(language.isin(names), family) if out is None else out.when(language.isin(names), family)
    return out.otherwise("latin")


def cut_bytes(text: Column, most: int) -> Column:
    """The longest beginning of a text of at most ``most`` bytes in UTF-8, cut between characters."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    # a cut character leaves at most three bytes of its own at the end
    return F.coalesce(*[F.try_validate_utf8(F.substring(raw, F.lit(1), F.length(raw) - n).cast("string")) for n in range(4)])


def newer_version(a: Column, b: Column) -> Column:
    """Whether version a is newer than b: three parts compared as numbers, missing or odd ones count as 0."""

    def parts(v: Column) -> Column:
        bare = F.split(F.regexp_replace(F.trim(v), "^v", ""), r"\.")
        return F.array(*[F.coalesce(F.try_element_at(bare, F.lit(i)).try_cast("int"), F.lit(0)) for i in (1, 2, 3)])

    return parts(a) > parts(b)


def cited_numbers(text: Column, known: int) -> Column:
    """Numbers of the pages an answer cites: those of a citation comment, else ``[n]`` marks; only from 1 to known, each once."""
    numbers = lambda found: F.filter(F.transform(found, lambda n: F.trim(n).try_cast("int")), lambda n: n.between(1, known))
    comment = numbers(F.split(F.regexp_extract(text, r"<!--\s*cited:\s*(.+?)\s*-->", 1), ","))
    marks = F.array_distinct(numbers(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1)))
    return F.when(F.size(comment) > 0, comment).otherwise(marks)


def without_thinking(text: Column) -> Column:
    """An answer without its thinking blocks, closed or not."""
    return F.trim(F.regexp_replace(text, r"(?s)<think(?:ing)?>.*?(?:</think(?:ing)?>|$)", ""))


def links_as_markdown(text: Column) -> Column:
    """Wiki links as markdown links to page fragments, outside code fences and code spans."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)```.*?(?:```|$)|`[^`\n]*`|\[\[[^\]]+\]\]|(?:(?!```|`[^`\n]*`|\[\[[^\]]+\]\]).)+"), 0)

    def linked(part: Column) -> Column:
        target, label = F.trim(F.regexp_extract(part, T.LINK, 1)), F.trim(F.regexp_extract(part, T.LINK, 2))
        # a form encodes spaces as +, a fragment as %20
        fragment = F.replace(F.url_encode(target), F.lit("+"), F.lit("%20"))
        link = F.concat(F.lit("["), F.when(label != "", label).otherwise(target), F.lit("](#"), fragment, F.lit(")"))
        return F.when(part.startswith("[[") & (target != ""), link).otherwise(part)

    return F.array_join(F.transform(parts, linked), "")


def numbered_context(results: Column) -> Column:
    """Results (array of structs of title, url, snippet) as a numbered block of text."""
    say = lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(r["title"], F.lit("")), F.lit("\n"), F.coalesce(r["url"], F.lit("")), F.lit("\n"), F.coalesce(r["snippet"], F.lit("")))
    return F.array_join(F.transform(results, say), "\n\n")


def answer_tokens(window: Column) -> Column:
    """Tokens that generating pages may take in a context window: a step table."""
    # fixed values
    return F.when(window >= 512_000, 32_768).when(window >= 256_000, 24_576).when(window >= 128_000, 16_384).otherwise(8_192)


def source_budget(window: Column, stable: Column) -> Column:
    """Characters of a source that fit one pass: the window less answer, stable context and instructions, within 8,000 and 300,000."""
    kept = F.least(F.floor(window * 0.25), F.greatest(F.lit(12_000), stable))
    free = window - F.floor(window * 0.15) - kept - F.greatest(F.lit(12_000), F.floor(window * 0.08))
    upper = F.least(F.lit(300_000), F.greatest(F.lit(8_000), F.floor(window * 0.6)))
    return F.least(F.greatest(free, F.lit(8_000)), upper)


# Where providers put reasoning in a line of a stream.
REASONING = ["$.choices[0].delta.reasoning_content", "$.choices[0].delta.reasoning", "$.delta.thinking", "$.message.thinking"]


def reasoning_text(line: Column) -> Column:
    """Reasoning in one line of a streamed answer (JSON, perhaps after ``data:``); empty if there is none. Its length counts it."""
    body = F.regexp_replace(line, r"^data:\s*", "")
    return F.concat(*[F.coalesce(F.get_json_object(body, path), F.lit("")) for path in REASONING])
