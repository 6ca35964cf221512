import pytest

import theoremill.llm.garbled as module
from theoremill.llm.garbled import CHAINS, Chains, garbled, repair

SCHEMA = "doc_id long, text string, source string, doc_kind string, grp string, chain int"
CLEAN = [
    "Le théorème précédent généralise déjà l’hypothèse cachée à la fin.",
    "Der größte Fixpunkt erfüllt die gewählte Ordnung für jede mögliche Lösung.",
    "Каждое равенство упрощает простое доказательство при строгом порядке.",
    "A NOTAÇÃO não contém a relação de precedência após a SEÇÃO ÂNCORA.",
    "Ścieżka w grafie łączy każda hipoteza bez użycia aksjomatu.",
    "这个假设推广了较弱的前提，每个等式保持树的高度。",
    "A plain line — “quoted”, 45 µs ± 2 %.",
]
WRONG = [
    (CLEAN[0], "utf_8", "cp1252"),
    (CLEAN[1], "utf_8", "cp437"),
    (CLEAN[2], "cp1251", "cp1252"),
    (CLEAN[2], "utf_8", "cp1251"),
    (CLEAN[4], "iso8859_2", "cp1250"),
    (CLEAN[0], "cp1252", "mac_roman"),
]


def garble(text, right, wrong):
    return text.encode(right, "replace").decode(wrong, "replace")


@pytest.fixture(scope="module")
def found(spark):
    clean = [(i, CLEAN[i % len(CLEAN)], f"s{i % 3}", "note", "g", 1) for i in range(700)]
    bad = [(1000 + i, "Plain words first.\n" + garble(*w), "s0", "note", "g", 1) for i, w in enumerate(WRONG)]
    bad += [(2000, garble(garble(CLEAN[0], "utf_8", "cp1252"), "utf_8", "cp1252"), "s1", None, "g", 1)]
    bad += [(2001, CLEAN[1].encode("utf_8").decode("ascii", "replace"), None, "faq", "g", 1)]
    odd = [(3000, None, "s0", "note", "g", 1), (3001, "", "s0", "note", "g", 1), (3002, "plain", None, None, "g", 1)]
    table = spark.createDataFrame(clean + bad + odd, SCHEMA)
    return table, bad


def test_found_and_repaired(found):
    table, bad = found
    rows = {r.doc_id: r for r in repair(table).collect()}
    assert set(rows) == {b[0] for b in bad}
    for i, (text, right, wrong) in enumerate(WRONG):
        if "�" not in garble(text, right, wrong) and "?" not in garble(text, right, wrong):
            assert rows[1000 + i].repaired == "Plain words first.\n" + text
    assert rows[2000].repaired == CLEAN[0] and rows[2001].chain == "lost" and rows[2001].repaired is None


def test_empty(found):
    table, _ = found
    assert garbled(table.limit(0)).count() == 0 and repair(table.limit(0)).count() == 0


def test_chains_undo():
    chains = Chains()
    for text, right, wrong in WRONG:
        bad = text.encode(right, "ignore").decode(wrong, "ignore")
        try:
            lossless = bad.encode(wrong) == text.encode(right)
        except UnicodeError:
            continue
        if lossless:
            assert chains.once(bad, CHAINS.index((wrong, right))) == text


def test_chains_of_several_pairs(found, monkeypatch):
    table, _ = found
    counts = module.train(table.filter("doc_id < 1000"))  # few texts: each garbled one would count much
    monkeypatch.setattr(module, "train", lambda *_: counts)
    four = CLEAN[1]
    for _ in range(4):
        four = garble(four, "utf_8", "mac_roman")
    mixed = garble(garble(CLEAN[0], "utf_8", "cp1252"), "utf_8", "cp437"), four
    more = table.sparkSession.createDataFrame([(4000 + i, t, "s2", "note", "g", 1) for i, t in enumerate(mixed)], SCHEMA)
    rows = {r.doc_id: r for r in repair(table.filter("doc_id < 1000").unionByName(more)).collect()}
    assert [rows[4000 + i].repaired for i in range(2)] == [CLEAN[0], CLEAN[1]]
    assert rows[4000].chain == "utf_8 as cp437, utf_8 as cp1252"


def test_entities_dropped_controls_and_question_marks(found):
    table, _ = found
    counts = module.train(table.filter("doc_id < 1000"))
    entities = "Le th&Atilde;&copy;or&Atilde;&uml;me pr&Atilde;&copy;c&Atilde;&copy;dent g&Atilde;&copy;n&Atilde;&copy;ralise d&Atilde;&copy;j&Atilde;&nbsp;."
    controls = "".join(c for c in garble(CLEAN[2], "utf_8", "latin_1") if not "\x80" <= c <= "\x9f")
    rows = [(1, entities), (2, controls), (3, "Le th?or?me pr?c?dent."), (4, "A question? Yes."), (5, "d&eacute;j&agrave; &amp; <b>"), (6, "© the authors …")]
    texts = table.sparkSession.createDataFrame([(i, t, "s0", "note", "g", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.chain for r in garbled(table.filter("doc_id < 1000").unionByName(texts.withColumn("doc_id", texts.doc_id + 5000)), counts=counts).collect()}
    assert got == {5001: "utf_8 as cp1252", 5002: "utf_8 as latin_1 without controls", 5003: "lost"}
    evidence = module.Evidence(counts)
    assert evidence.undo(entities, CHAINS.index(("cp1252", "utf_8")))[1] == "Le théorème précédent généralise déjà."
    assert not evidence.repair(controls, module.DROPPED).isascii()


def test_a_corpus_twice_as_large_gives_the_same(found):
    table, bad = found
    again = table.unionByName(table.withColumn("doc_id", table.doc_id + 10_000))
    rows = {r.doc_id for r in garbled(again).collect()}
    assert rows == {b[0] for b in bad} | {b[0] + 10_000 for b in bad}


def test_only_more_pairs_than_are_kept_lose_the_rarest(found, monkeypatch):
    table, _ = found
    whole = module.train(table)
    monkeypatch.setattr(module, "PAIRS", 100)
    few = module.train(table)
    assert 0 < len(few.pairs) <= 100 < len(whole.pairs) and few.first == whole.first and few.second == whole.second
    assert min(few.pairs.values()) >= max(n for p, n in whole.pairs.items() if p not in few.pairs) / 1.1
