import random

import pytest

from corpusmith.llm import sentences as S


def english(rnd):
    noun, verb = ["river", "vector", "index", "harbor", "ledger", "graph", "bridge"], ["quotes", "merges", "tracks", "splits"]
    name = rnd.choice(["Zovupa", "Tikugri", "Lemano", "Pifugu", "Sarudo", "Gridaba"])
    n = lambda: rnd.choice(noun)
    kinds = [
        f"The {n()} {rnd.choice(verb)} the {n()} of Dr. {name}.", f"When the {n()} {rnd.choice(verb)} approx. {rnd.randint(1, 99)}.5 MB, Prof. {name} {rnd.choice(verb)} the {n()}!",
        f"A {n()} asked “does the {n()} match?” and {rnd.choice(verb)} the {n()}.", f"It {rnd.choice(verb)} the {n()} … no, it {rnd.choice(verb)} the {n()}?", f"J. R. {name} {rnd.choice(verb)} the {n()}...",
    ]
    return rnd.choice(kinds)


@pytest.fixture(scope="module")
def corpus():
    """Paragraphs of sentences whose ends are known."""
    rnd = random.Random(11)
    docs = []
    for i in range(400):
        paragraphs = [[english(rnd) for _ in range(rnd.randint(1, 4))] for _ in range(3)]
        docs.append((i, "\n\n".join(" ".join(p) for p in paragraphs), [s for p in paragraphs for s in p]))
    return docs


@pytest.fixture(scope="module")
def model(spark, corpus):
    return S.train(spark.createDataFrame([c[:2] for c in corpus], "doc_id long, text string"))


def cut(text, model):
    return [text[s:e] for s, e in S.units(text, model, {})]


def test_held_out_accuracy(model):
    rnd = random.Random(99)
    good = all_ = 0
    for _ in range(100):
        said = [english(rnd) for _ in range(4)]
        out = cut(" ".join(said), model)
        good += len(set(said) & set(out))
        all_ += len(said)
    assert good / all_ > 0.97


def test_spark_equals_local(spark, corpus, model):
    docs = spark.createDataFrame([(*c[:2], "x") for c in corpus[:40]] + [(900, None, "x"), (901, "", "x"), (902, " \n ", "x")], "doc_id long, text string, char_start string")
    out = S.sentences(docs, model).toPandas().sort_values(["doc_id", "char_start"])
    want = [(i, s, e) for i, t, _ in corpus[:40] for s, e in S.units(t, model, {})]
    assert [tuple(r) for r in out.itertuples(index=False)] == want


def test_layout(model):
    text = (
        "---\ntitle: x. Y\n---\n\n# The head\n\nThe river quotes\nthe ledger. The graph merges it.\n- One item\n  that goes on\n- Two\n\n> Quoted line\n\n"
        "1. First. Second one here.\n2. Next\n\n```\ncode. More.\n```\n\n| a | b |\n|---|---|\n\n(The index tracks it.) Last line"
    )
    assert cut(text, model) == [
        "The head", "The river quotes\nthe ledger.", "The graph merges it.", "One item\n  that goes on", "Two", "Quoted line",
        "First.", "Second one here.", "Next", "(The index tracks it.)", "Last line",
    ]


def test_scripts(model):
    assert cut("编辑问：“数据在哪里？”然后更新了图谱！随后表格重复。", model) == ["编辑问：“数据在哪里？”然后更新了图谱！", "随后表格重复。"]
    assert cut("「担当者は「橋はどこ？」と言い、比較する。」その後、隠す。", model) == ["「担当者は「橋はどこ？」と言い、比較する。」", "その後、隠す。"]
    assert cut("หน้าสั้นแบ่ง 94 สัญญาของสานา โดยปกติหน้าลบลิงก์", model) == ["หน้าสั้นแบ่ง 94 สัญญาของสานา", "โดยปกติหน้าลบลิงก์"]
    assert cut("फिर खाता रोकता है। आज नदी बदलता है।", model) == ["फिर खाता रोकता है।", "आज नदी बदलता है।"]
    assert cut("Η ομάδα βρίσκει; Σήμερα γράφει.", model) == ["Η ομάδα βρίσκει;", "Σήμερα γράφει."]


def test_forward_backward_equals_enumeration(model):
    """Posteriors of neighbouring gaps equal the sum over all ways to place boundaries."""
    import itertools

    keys = [("the", "A.", "r", "U"), ("A.", "A.", "", "U"), ("~l", "~l.", "the", "U")]
    weights = {}
    for events in itertools.product((0, 1), repeat=3):
        w, before = 1.0, 0
        for e, (a, word, nxt, shape) in zip(events, keys):
            p = min(max(model.boundary("^" if before else a, word), 1e-4), 1 - 1e-4)
            w *= p * model.odds(a, word, nxt, shape) if e else 1 - p
            before = e
        weights[events] = w
    total = sum(weights.values())
    want = [sum(w for ev, w in weights.items() if ev[i]) / total for i in range(3)]
    assert model.chain(keys) == pytest.approx(want)


def test_long_text_and_empty(spark, model):
    assert len(cut("The river quotes the ledger. " * 20000, model)) == 20000
    assert S.sentences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tables_equal_local_model(spark, corpus, model):
    docs = spark.createDataFrame([c[:2] for c in corpus] + [(900, None), (901, "A\0B. It merges.\n\nJ. R. Lemano tracks it"), (901, "One. Two")], "doc_id long, text string")
    out = sorted(map(tuple, S.sentences(docs).collect()))
    model = S.train(docs)
    assert out == sorted((i, s, e) for i, t in map(tuple, docs.collect()) if t for s, e in S.units(t, model, {}))


def test_rare_contexts_count_however_many_there_are(spark):
    """An abbreviation before 60 names, each once, ends three paragraphs; 160,000 other contexts are more frequent than its own."""
    names = [f"{a}{b}lemas" for a in "BCDFGHJK" for b in "aeiouyrl"][:60]
    told = [f"The river saw zq. {n} quoting ledgers. The bridge quotes ledgers." for n in names] + ["The river saw zq."] * 3
    noise = [" ".join(f"It saw {k:05x}g. Then it saw {k:05x}g. Then" for k in range(j, j + 1600)) + " it quotes ledgers." for j in range(0, 160_000, 1600)]
    docs = spark.createDataFrame(list(enumerate(told)) + list(enumerate(noise, 1000)), "doc_id long, text string")
    out = {i: [] for i in range(len(told))}
    for r in S.sentences(docs).where("doc_id < 1000").collect():
        out[r["doc_id"]].append(told[r["doc_id"]][r["char_start"] : r["char_end"]])
    assert [sorted(out[i]) for i in range(60)] == [sorted([f"The river saw zq. {n} quoting ledgers.", "The bridge quotes ledgers."]) for n in names]


def test_spaces_inside_thai_sentences(spark):
    """A space before the repetition mark, which never ends a paragraph, doesn't end a sentence; other spaces do."""
    rnd = random.Random(5)
    starts, ends = ["หน้า", "โดย", "แมว", "ครู"], ["สัญญา", "ปลา", "ลิงก์", "บ้าน"]
    say = lambda: f"{rnd.choice(starts)}เขียนมาก ๆ{rnd.choice(ends)}" if rnd.random() < 0.5 else f"{rnd.choice(starts)}อ่าน{rnd.choice(ends)}"
    told = [[say() for _ in range(rnd.randint(1, 3))] for _ in range(300)]
    docs = [(i, " ".join(s)) for i, s in enumerate(told)] + [(1000 + i, "The river quotes ledgers. The bridge quotes ledgers.") for i in range(100)]
    out = {i: [] for i in range(300)}
    for r in S.sentences(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id < 1000").collect():
        out[r["doc_id"]].append((r["char_start"], docs[r["doc_id"]][1][r["char_start"] : r["char_end"]]))
    assert [[t for _, t in sorted(out[i])] for i in range(300)] == told


def test_marks_of_unspaced_scripts(model):
    assert cut("ខ្ញុំសរសេរ។ គាត់អាន។", model) == ["ខ្ញុំសរសេរ។", "គាត់អាន។"]
    assert cut("သူရေးသည်။ သူဖတ်သည်။", model) == ["သူရေးသည်။", "သူဖတ်သည်။"]
    assert cut("ཡི་གེ་འབྲི། །དེབ་ཀློག །", model)[0] == "ཡི་གེ་འབྲི། །"
    assert cut("ຂ້ອຍຂຽນ ລາວອ່ານ", model) == ["ຂ້ອຍຂຽນ", "ລາວອ່ານ"]


def _agreement(out, told):
    """Precision and recall of the units of documents whose sentences are known, and how many are exactly right."""
    both = sum(len(set(out[i]) & set(s)) for i, s in told.items())
    return both / max(1, sum(map(len, out.values()))), both / sum(map(len, told.values()))


def _unpunctuated(spark, marked, told, join=" "):
    docs = [(i, t) for i, t in enumerate(marked)] + [(10_000 + i, join.join(s)) for i, s in told.items()]
    texts = dict(docs)
    out = {i: [] for i in told}
    for r in S.sentences(spark.createDataFrame(docs, "doc_id long, text string")).where("doc_id >= 10000").collect():
        out[r["doc_id"] - 10_000].append(texts[r["doc_id"]][r["char_start"] : r["char_end"]].strip())
    return out


def test_unpunctuated_english(spark):
    """Transcripts without marks and capitals, held out from the marked text that the model learns from."""
    rnd = random.Random(21)
    noun, verb = ["river", "vector", "index", "harbor", "ledger", "graph", "bridge", "summary", "archive", "meeting"], ["quotes", "merges", "tracks", "splits", "renames"]
    n, v = lambda: rnd.choice(noun), lambda: rnd.choice(verb)
    say = lambda: rnd.choice([f"the {n()} {v()} the {n()} of every {n()}", f"when the {n()} {v()} a {n()} it {v()} the old {n()}", f"most of the {n()} {v()} them without a {n()}", f"we {v()} every {n()} before the {n()} {v()} us", f"in practice nobody {v()} the {n()} and the {n()}"])
    marked = [" ".join(s.capitalize() + "." for s in (say() for _ in range(rnd.randint(2, 5)))) for _ in range(600)]
    told = {i: [say() for _ in range(rnd.randint(8, 15))] for i in range(40)}
    precision, recall = _agreement(_unpunctuated(spark, marked, told), told)
    assert precision > 0.9 and recall > 0.9


def test_unpunctuated_chinese(spark):
    """The same without spaces: an event after every character."""
    rnd = random.Random(22)
    noun, verb = ["数据", "链接", "页面", "标题", "快照", "索引", "桥梁", "会议"], ["更新", "删除", "合并", "重复"]
    n, v = lambda: rnd.choice(noun), lambda: rnd.choice(verb)
    say = lambda: rnd.choice([f"今天{n()}又{v()}了{n()}吗", f"随后他们{v()}旧的{n()}了", f"通常{n()}不能{v()}任何{n()}呢"])
    marked = ["".join(say() + "。" for _ in range(rnd.randint(2, 5))) for _ in range(500)]
    told = {i: [say() for _ in range(rnd.randint(8, 12))] for i in range(30)}
    precision, recall = _agreement(_unpunctuated(spark, marked, told, ""), told)
    assert precision > 0.9 and recall > 0.9


def test_unmarked_stretches_that_are_short_or_marked_stay_whole():
    assert S.word_gaps("a title of a few words without a mark", 0, 37) == []
    long = "word " * 60
    assert len(S.word_gaps(long, 0, len(long))) == 59
    assert S.word_gaps(long + ".", 0, len(long) + 1) == []
    assert S.word_gaps("数据" * 25, 0, 50) == [] and len(S.word_gaps("数据" * 30, 0, 60)) == 59
