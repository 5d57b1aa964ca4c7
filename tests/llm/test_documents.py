from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phyllary.llm.mixing import fair_schedule, mix_report, mix_sources
from phyllary.llm.packing import difference, pack, pack_items, packing_report
from phyllary.llm import segmentation
from phyllary.llm.segmentation import sentences
from phyllary.llm.sentences import split_sentences
from phyllary.llm.tokens import SLICE, TOKENIZER, VOCABULARIES, count_tokens, encoder, token_count

TEXTS = [
    ["Dr. Vander, Jr., annotated sheet no. 6793 as “var. nov.” but never published it.", "We broke camp at 6 a.m. and turned back... only to start again by noon.", "He wrote: “We found it at last.”", "Next."],
    ["“Is it rare?” asked A. Lee on the way down.", '"Careful with the frond!" shouted the guide.', "Really?!", "(Not seen again after 1893.)", "We reached Oslo at 5 p.m.", "Rain fell for 5 hrs. and the river rose by 9.2 m.", "The trees fell, etc.", "No. 4784 was lost."],
    ["Am 16. Juni 1951 stiegen wir auf den Berg (ca. 314 m ü. M.).", "Die 3. Exkursion führte nach Ulm.", "Nach dem 2. Weltkrieg war alles zerstört.", "Der Beleg liegt im Herbar AHFM, Fasz. 16.", "„Hier wächst nichts mehr“, sagte der Wirt.", "Er notierte: „Der Farn ist verschwunden.“", "Die Art wächst z. B. an Felsen, u. a. bei Ulm."],
    ["« Quelle belle fougère ! » s'écria le guide.", "Il nota : « La plante est rare. »", "Récolté par M. Dupont, à env. 1016 m.", "Le Pr. Durand a vu.", "Quel terrain difficile !"],
    ["¿Quién escribió «Roma» en la etiqueta?", "Los EE. UU. no figuran.", "Llegamos a las 5 p. m.", "La Sra. Gil dijo: «No volveremos más.»", "¡Alto!"],
    ["«Осторожно!» — крикнул проводник.", "Вид растёт на камнях, в трещинах и т. д.", "Собрано близ г. Вельма в 1950 г. экспедицией.", "Вид впервые описан в 1895 г.", "Где же видел проф. Н. К. Твардин этот вид?"],
    ["Ο κ. Βελίδης συνέλεξε το δείγμα το 1925.", "Πού βρέθηκε το δείγμα αρ. 123;", "Η πλαγιά είναι υγρή· το ρέμα είναι ξηρό.", "Βλ. εικ. 8, σελ. 9."],
    ["이 식물은 습한 바위에서 자란다.", "“찾았다!”라고 안내인이 외쳤다.", "표본 No. 4890은 보관되지 않았다."],
    ["डॉ. वेलमन ने नमूना सं. 4485 देखा।", 'मार्गदर्शक ने कहा, "रुको!"', "तना 3.5 सेमी मोटा है।"],
    ["حفظ د. سلمون العينة رقم 9185 في المعشب.", "هل هذا هو النوع نفسه؟"],
]
TIGHT = [
    ["他写道：“此地已无人居住。”", "“找到了！”他高兴地说。", "参见图7（比例1.5倍）……仍需核对。", "太好了！！", "这是不是同一种植物？"],
    ["「見つけた！」と案内人は叫んだ。", "採集者は「ここには何もない。」と書いた。", "なんと美しい葉だろう…。", "葉は長さ14.9cm、No.4941と比較せよ。"],
]


@pytest.mark.parametrize(("parts", "glue"), [(t, g) for t in TEXTS for g in (" ", "  ", "\n", "\n\n")] + [(t, g) for t in TIGHT for g in ("", " ", "\n\n")])
def test_sentences(parts, glue):
    text = glue.join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_blank_lines_wraps_and_spaces():
    text = "  Day 19\n \nWe met Mr. and\nMrs. Lee.\r\n\r\nYours sincerely,\n\n18. Tag\n"
    assert [text[a:b] for a, b in sentences(text)] == ["Day 19", "We met Mr. and\nMrs. Lee.", "Yours sincerely,", "18. Tag"]
    assert sentences("wide at the base.Aspelidium grows.") == [(0, 17), (17, 34)]
    assert sentences(None) == sentences("") == sentences(" \n\n \t") == []
    thai = "พืชนี้หายากมาก พบได้ทั่ว ๆ ไปตามหน้าผา พบที่ความสูง 2692 เมตรจากระดับน้ำทะเล"
    assert len(sentences(thai)) == 3


@pytest.mark.parametrize(("text", "lang", "parts"), [
    ("The bottle has a cap. It was red.", "en", 2), ("She loves modern art. He prefers music.", "EN", 2), ("He opened the tab. Nothing came.", "eng", 2), ("We live in the U.S. It is large.", "en-GB", 2),
    ("Vimos el mar. Fue bonito.", "spa", 2), ("Nous sommes au col. Il neige.", "fra", 2), ("Nous sommes au col. Il neige.", "en", 2), ("We met Col. Smith in Mar. 1920.", "en", 1), ("We met Col. Smith in Mar. 1920.", None, 1), ("Ella vio el cap. 3 de la obra.", "es-MX", 1),
    ("The sheet is now at LEG. It is torn.", "en", 2), ("It went to DET. Stop!", "zh-Hans", 2), ("SEE DR. SMITH AT MT. ROSS.", "en", 1), ("Der Weg ist weit, vgl. Abb. 4.", "en", 1), ("He took vitamin C. The rest is lost.", "en", 2),
    ("It grew (see the note. " + "And more of it, " * 60 + "as he said. All of it) on rocks. Next.", "en", 2), ("It grew (see the note. Next one. Last.", "en", 3), ("“" + "很长的话，" * 80 + "找到了！”他高兴地说。太好了！", "zh", 2), ("x" * 500 + " Dr. Lee came. Next.", None, 2),
])
def test_languages_brackets_and_codes(text, lang, parts):
    assert len(sentences(text, lang)) == parts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("Dr St Mt A M M. No fig Abb cap art mar Leg LEG etc m p.m. 12 3.5 The Er Il und d. „ “ ( ) « » г м Вид вид υ Βλ 说 “找到了！” है । word Word words. Words! \n".split(" ") + ["."]), max_size=24), st.sampled_from(["", " "]), st.sampled_from(["en", "de", "fr", None, "ru"]))
def test_plain_cases_are_decided_as_by_the_tables(words, glue, lang):
    text = glue.join(words)
    plain = sentences(text, lang)
    quick, segmentation._at_once = segmentation._at_once, lambda *_: None
    try:
        assert sentences(text, lang) == plain
    finally:
        segmentation._at_once = quick


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB. !?\n「」“”()。ก 1;…«»é", max_size=80))
def test_sentences_cover_all_but_blanks(text):
    spans = sentences(text)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    inside = {i for a, b in spans for i in range(a, b)}
    assert all(c.isspace() for i, c in enumerate(text) if i not in inside)


def test_sentence_rows(spark):
    long = "A sentence (with brackets. " * 4000 + "End."
    df = spark.createDataFrame([(1, "One. Two."), (2, None), (3, ""), (1, "One. Two."), (4, long)], "doc_id long, text string").selectExpr("*", "7 as sent_no")
    out = split_sentences(df, "doc_id", "text", with_text=True)
    rows = [tuple(r) for r in out.where("doc_id = 1").collect()]
    assert sorted(rows) == [(1, 1, 0, 4, "One."), (1, 1, 0, 4, "One."), (1, 2, 5, 9, "Two."), (1, 2, 5, 9, "Two.")]
    assert out.where("doc_id in (2, 3)").count() == 0 and out.where("doc_id = 4").agg({"end_char": "max"}).first()[0] == len(long)
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0


def test_tokens(spark):
    path = f"{VOCABULARIES}/{TOKENIZER}"
    assert count_tokens(None, path) == count_tokens("", path) == 0
    text = "The frond of Pteris vittata, 12.5 cm long; см. рис. 3. " * 5000
    assert len(text) > 2 * SLICE and count_tokens(text, path) == len(encoder(path).encode_ordinary(text))
    assert count_tokens("x" * (2 * SLICE + 5), path) > 0
    df = spark.createDataFrame([("hello world",), (None,)], "t string")
    assert [r.n for r in df.select(token_count(df.t).alias("n")).collect()] == [2, 0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.integers(60, 120))
def test_pack_fits_and_keeps_all(sizes, capacity):
    windows = pack(sizes, capacity)
    assert len(windows) == len(sizes)
    sums = Counter()
    for s, w in zip(sizes, windows, strict=True):
        sums[w] += s
    assert all(v <= capacity for v in sums.values()) and len(sums) <= max(1, 2 * -(-sum(sizes) // capacity))
    for k in (1, 2, 5):
        parts = difference(sizes, k)
        assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(len(sizes)))


def test_differencing_balances():
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in difference([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]


def test_containers(spark):
    sizes = [(i, 1 + (i * 37) % 90) for i in range(500)] + [(1000, 250), (1001, 200), (1002, 0), (1003, None), (1004, -5), (7, 30)]
    items = spark.createDataFrame(sizes, "doc_id long, n long")
    runs = spark.createDataFrame([("a", 100), ("b", 1000), ("none", None)], "run_name string, capacity_tokens int")
    out = pack_items(items, "doc_id", "n", runs, block_items=64)
    rows = out.collect()
    want = Counter({s[0]: 0 for s in sizes if s[1] and s[1] > 0})
    for run, cap in (("a", 100), ("b", 1000)):
        mine = [r for r in rows if r.run_name == run]
        held, got = defaultdict(int), Counter()
        for r in mine:
            held[r.container] += r.piece_size
            got[r.doc_id] += r.piece_size
        assert max(held.values()) <= cap and set(got) == set(want) and got[1000] == 250 and sum(got.values()) == sum(s[1] for s in sizes if s[1] and s[1] > 0)
    assert [(r.piece, r.piece_start, r.piece_size) for r in sorted(rows, key=lambda r: r.piece) if r.run_name == "a" and r.doc_id == 1000] == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    report = {r.run_name: r for r in packing_report(out, runs).collect()}
    assert report["a"].filled_share > 0.9 and report["b"].filled_share > 0.9
    assert pack_items(items.limit(0), "doc_id", "n", runs).count() == 0 and pack_items(items, "doc_id", "n", runs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9), st.integers(1, 400))
def test_schedule_is_fair(weights, slots):
    shares = {f"s{i}": w / sum(weights) for i, w in enumerate(weights)}
    out = fair_schedule(shares, slots)
    got = Counter()
    for t, (s, j) in enumerate(out, 1):
        assert j == got[s]
        got[s] += 1
        assert all(abs(got[x] - w * t) < 1 + 1e-6 for x, w in shares.items())


def test_mixture(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(400)] + [(1000 + i, "small", 9) for i in range(12)] + [(2000, "other", 5), (2001, None, 5), (2002, "big", 0), (2003, "big", None)]
    items = spark.createDataFrame(rows, "doc_id long, source string, n long")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("absent", 0.1, 9)], "source string, target_share double, max_repeats int")
    mixed = mix_sources(items, "doc_id", "source", "n", targets)
    got = mixed.collect()
    uses = Counter(r.doc_id for r in got)
    assert {r.source for r in got} == {"big", "small"} and max(uses[i] for i in range(1000, 1012)) == 3 and max(uses[i] for i in range(400)) == 1
    report = {r.source: r for r in mix_report(mixed, targets).collect()}
    assert abs(report["small"].reached_share - 0.2 / 0.9) < 0.01 and report["absent"].reached_share == 0.0 and report["small"].most_uses == 3
    order = sorted(got, key=lambda r: (r.slot, r.slot_start))
    total, own = 0, 0
    for r in order:
        total, own = total + r["size"], own + r["size"] * (r.source == "small")
        assert abs(own - 0.2 / 0.9 * total) < 2 * 16
    assert mix_sources(items.limit(0), "doc_id", "source", "n", targets).count() == 0
    more = {r.source: r for r in mix_report(mix_sources(items, "doc_id", "source", "n", targets, total=100_000), targets).collect()}
    assert more["small"].items == 36 and more["big"].items == 400
