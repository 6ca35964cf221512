"""Garbled text from wrong decoding: expectation–maximisation over latent chains of encodings.

A chain says as what bytes of which right encoding were read. For each record and chain the evidence is
how much likelier the text becomes when the chain is undone, by a character bigram model of the whole
corpus; a garbled record's sentences are a mixture of garbled and sound ones, so a sentence that speaks
against a chain counts little and a weak sign in favour counts something. Weak evidence is pooled: the share
of each chain among the records of a source and field is estimated together with the posterior of each
record's chain. Records are then repaired by the chain of the greatest posterior, one after another while
what is left still shows one. Characters written as HTML entities are read as the characters they name.
"""

from __future__ import annotations

import html
import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.llm.workers import once
from theoremill.runtime import BROADCAST_ROWS, cut, lookup

# Encodings that texts are written in, and that they are wrongly read as.
WESTERN = ("cp1252", "mac_roman", "cp850", "cp437")
CENTRAL = ("cp1250", "iso8859_2")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5")
EAST_ASIAN = ("gb18030", "big5", "shift_jis", "euc_kr")
READ_AS = (*WESTERN, *CENTRAL, *CYRILLIC)

#: (read as, written in) of every chain; utf_8 read as anything, and legacy encodings read as one another.
CHAINS = (
    *((wrong, "utf_8") for wrong in (*READ_AS, "iso8859_15", "cp1254", "gb18030", "big5", "shift_jis", "euc_kr")),
    *((wrong, right) for right in CYRILLIC for wrong in (*CYRILLIC, "cp1252", "mac_roman", "cp437") if wrong != right),
    *((wrong, right) for right in CENTRAL for wrong in (*CENTRAL, "cp1252", "mac_roman", "cp1251") if wrong != right),
    *((wrong, "cp1252") for wrong in ("mac_roman", "cp850", "cp437", "cp1251", "cp1250", "iso8859_2", "koi8_r")),
    *(("cp1252", right) for right in ("mac_roman", "cp850", "cp437")),
    *((wrong, right) for right in EAST_ASIAN for wrong in ("cp1252", "mac_roman")),
    ("latin_1 without controls", "utf_8"),
)
#: The chain whose characters U+0080 to U+009F were dropped afterwards.
DROPPED = len(CHAINS) - 1
LOST = len(CHAINS)  # characters were replaced by U+FFFD or a question mark
NAMES = (*(f"{right} as {wrong}" for wrong, right in CHAINS), "lost")

#: Nats: what a sentence must gain to be repaired, the loss per undecodable byte, the gain per U+FFFD, the
#: gain per sequence of bytes that is well-formed UTF-8, the loss per letter of a word that turns out to be a
#: symbol, and what a character of an unlikely token loses at least.
MARGIN, BROKEN, REPLACED, SEQUENCE, SYMBOL, UNLIKELY = 2.0, 4.0, 8.0, 4.0, 3.0, 6.0
#: Share of a garbled record's sentences that are garbled, before anything is seen of them.
PASSAGE = math.exp(-MARGIN)
#: Nats: what another chain must gain on a text that one has been undone on.
NEXT = math.log(len(NAMES))
#: Most distinct character pairs that are kept. Only a corpus with more loses its rarest ones.
PAIRS = 400_000
#: Weight of the whole corpus, in records, in the shares of one source and field; rounds of estimation.
POOL, ROUNDS = 20.0, 6
_KEPT = 200_000
_TOKEN = re.compile(r"[^ \t\r\n]+")
_ENTITY = re.compile(r"&#?\w+;")
_SENTENCE = re.compile(r"(?<=[.!?。])[ \t]+|[\r\n]+")


def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte of a single-byte encoding; bytes it leaves undefined, and the controls that other
    readers put there, stand for themselves."""
    table = {chr(b): b for b in range(128, 160)} if encoding in ("cp1252", "cp1254") else {}
    for b in range(256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


def suspect(token: str) -> bool:
    """Whether a token can show anything: a character that isn't ASCII, an entity or a question mark."""
    return not token.isascii() or "?" in token or ("&" in token and _ENTITY.search(token) is not None)


@dataclass
class Counts:
    """Counts of character pairs, and of characters as first and second of any pair."""

    pairs: dict[str, int]
    first: dict[str, int]
    second: dict[str, int]


class Model(dict):
    """Log likelihood of a token under character bigrams that back off to single characters; the mapping holds
    the pairs asked for so far."""

    def __init__(self, counts: Counts) -> None:
        super().__init__()
        self.counts = counts
        self.total = sum(counts.second.values()) + 1.0
        self.after: dict[str, list[str]] = defaultdict(list)
        for pair in counts.pairs:
            if pair[1] > "\x7f" and pair[1] != "�":
                self.after[pair[0]].append(pair[1])
        self.gaps: dict[str, float] = {}

    def __missing__(self, ab: str) -> float:
        counts = self.counts
        back = (counts.second.get(ab[1], 0) + 0.1) / (self.total + 1000)
        if len(self) >= 2 * PAIRS:
            self.clear()
        p = self[ab] = math.log((counts.pairs.get(ab, 0) + 4 * back) / (counts.first.get(ab[0], 0) + 4))
        return p

    def __call__(self, token: str) -> float:
        padded = f"\n{token}\n"
        return sum([self[a + b] for a, b in zip(padded, padded[1:])]) - BROKEN * token.count("�")

    def gap(self, a: str, b: str) -> float:
        """How much likelier some other character than ASCII is between ``a`` and ``b`` than a question mark."""
        gain = self.gaps.get(a + b)
        if gain is None:
            other = sum(math.exp(self[a + x] + self[x + b]) for x in self.after.get(a, ()) if x + b in self.counts.pairs)
            gain = math.log(other + 1e-30) - self[a + "?"] - self["?" + b]
            if len(self.gaps) >= PAIRS:
                self.gaps.clear()
            self.gaps[a + b] = gain
        return gain


class Chains:
    """Undoes chains. ``model`` chooses among the characters that dropped controls may have belonged to."""

    def __init__(self, model: Model | None = None) -> None:
        self.model = model
        self.tables = {wrong: _bytes_of(wrong) for wrong in (*READ_AS, "iso8859_15", "cp1254")}
        # Where both encodings have single bytes, a chain is undone character by character.
        self.maps: list[dict[str, str] | None] = []
        for wrong, right in CHAINS:
            single = wrong in self.tables and right in self.tables
            self.maps.append({c: bytes([b]).decode(right, "replace") for c, b in self.tables[wrong].items()} if single else None)
        self.translations = [m and str.maketrans(m) for m in self.maps]
        self.known = [m and frozenset(m) for m in self.maps]
        #: Letters that turn out to be symbols.
        self.lowered = [frozenset(c for c, d in m.items() if c.isalpha() and not d.isalpha()) if m else frozenset() for m in self.maps]
        self.remains = self._remains(model.counts.second) if model is not None else {}

    @staticmethod
    def _remains(characters: dict[str, int]) -> dict[str, list[str]]:
        """What is left of each character of the corpus as UTF-8 read as Latin-1 without U+0080 to U+009F."""
        out: dict[str, list[str]] = defaultdict(list)
        for c in characters:
            if c >= "\xa0" and c != "�" and not "\ud800" <= c <= "\udfff":
                left = bytes(b for b in c.encode() if not 0x80 <= b <= 0x9F).decode("latin_1")
                out[left].append(c)
        return out

    def raw(self, text: str, wrong: str) -> bytes | None:
        """The bytes that were read as ``text``; None if no bytes can have been."""
        table = self.tables.get(wrong)
        try:
            if table is None:
                return text.replace("�", "?").encode(wrong)
            if "�" in text:
                return bytes(255 if c == "�" else table[c] for c in text)
            return bytes(map(table.__getitem__, text))
        except (KeyError, UnicodeEncodeError):
            return None

    def refill(self, text: str) -> str | None:
        """``text`` with every remainder of a character completed by the likeliest one."""
        out, at, before = [], 0, "\n"
        while at < len(text):
            c = text[at]
            if c > "\x7f":
                for length in (4, 3, 2, 1):
                    if found := self.remains.get(text[at : at + length]) if at + length <= len(text) else None:
                        following = text[at + length : at + length + 1] or "\n"
                        m = self.model
                        c = found[0] if len(found) == 1 else max(found, key=lambda x: m[before + x] + (m[x + following] if following < "\x80" else 0))
                        at += length - 1
                        break
                else:
                    return None
            out.append(c)
            before, at = c, at + 1
        return None if (done := "".join(out)) == text else done

    def once(self, text: str, chain: int) -> str | None:
        """``text`` with the chain undone; U+FFFD where bytes are missing; None if it can't have been."""
        if chain == DROPPED:
            return self.refill(text)
        wrong, right = CHAINS[chain]
        if "�" in text and right != "utf_8":
            parts = [self.once(part, chain) or part for part in text.split("�")]
            return None if (out := "�".join(parts)) == text else out
        if self.known[chain] is not None:
            if not self.known[chain].issuperset(text):
                return None
            out = text.translate(self.translations[chain])
            return None if out == text else out
        raw = self.raw(text, wrong)
        out = None if raw is None else raw.decode(right, "replace")
        return None if out == text else out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character pairs of the tokens that can show anything, added up over the partition."""
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pair", "n"])

    for batch in batches:
        words: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            if text and suspect(text):
                words.update(t for t in _TOKEN.findall(text) if not t.isascii() or "?" in t)
        for token, n in words.items():
            padded = f"\n{token}\n"
            for ab in zip(padded, padded[1:]):
                counts["".join(ab)] += n
        if len(counts) > 1_000_000:
            yield out()
            counts.clear()
    if counts:
        yield out()


def train(texts: DataFrame, text: str = "text") -> Counts:
    """Counts of the character pairs of all texts. All distinct pairs are kept while they are at most PAIRS;
    beyond, the least count that keeps at most so many is the bound. Counts of single characters, which are
    bounded by Unicode, are those of all pairs in any case."""
    counts = cut(texts.select(text).mapInArrow(_pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    steps = counts.groupBy(F.floor(8 * F.log2("n")).alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()  # at most 8 x 63 rows
    kept, least = 0, 0
    for row in sorted(steps, reverse=True):
        kept += row.k
        if kept > PAIRS:
            least = row.step + 1
            break
    pairs = {r.pair: r.n for r in counts.filter(F.floor(8 * F.log2("n")) >= least).toLocalIterator()}
    of = lambda at: {r.c: r.n for r in counts.groupBy(F.substring("pair", at, 1).alias("c")).agg(F.sum("n").alias("n")).toLocalIterator()}
    return Counts(pairs, of(1), of(2))


def _soft(gains: np.ndarray) -> np.ndarray:
    """Evidence of a sentence: it is garbled with probability PASSAGE and then so much likelier."""
    return np.logaddexp(math.log(1 - PASSAGE), math.log(PASSAGE) + gains)


class Evidence:
    """What undoing each chain gains, by token (kept in a bounded table) and by sentence."""

    def __init__(self, counts: Counts) -> None:
        self.model = Model(counts)
        self.chains = Chains(self.model)
        self.kept: dict[str, tuple[np.ndarray, bool]] = {}

    def gains(self, token: str) -> np.ndarray:
        """For each chain how much likelier the token is with it undone, 0 where it can't have been."""
        token, chains, model = html.unescape(token), self.chains, self.model
        out = np.zeros(LOST + 1, np.float32)
        base, done, raws = model(token), {}, {}
        for chain, (wrong, right) in enumerate(CHAINS):
            if chain == DROPPED:
                undone = chains.refill(token)
            elif (known := chains.known[chain]) is not None:
                undone = chains.once(token, chain) if known.issuperset(token) or "�" in token else None
            elif "�" in token and right != "utf_8":
                undone = chains.once(token, chain)
            else:
                if wrong not in raws:
                    raws[wrong] = chains.raw(token, wrong)
                undone = None if raws[wrong] is None else raws[wrong].decode(right, "replace")
            if undone is None or undone == token:
                continue
            if right == "utf_8" and chain != DROPPED:
                # As often as byte sequences are well-formed: a text may have been garbled over and over.
                # What is likely as it stands needn't be weighed where none is.
                best, shape, odd = -BROKEN * undone.count("�"), -SEQUENCE * (wrong == "gb18030"), base < -UNLIKELY * (len(token) + 1)
                while undone is not None and ((formed := len(undone) - len(undone.encode("ascii", "ignore")) - undone.count("�")) or odd):
                    if (gain := done.get(undone)) is None:
                        gain = done[undone] = model(undone) - base
                    shape += SEQUENCE * formed
                    best, odd = gain + shape if best <= 0 else max(best, gain + shape), False
                    undone = chains.once(undone, chain)
                out[chain] = best
                continue
            if (gain := done.get(undone)) is None:
                gain = done[undone] = model(undone) - base
            if chain == DROPPED:
                gain += SEQUENCE * max(0, len(token) - len(undone)) - 1  # so that it stands back where nothing was dropped
            elif len(token) == 1:
                if undone.isalpha() and not token.isalpha():
                    continue  # a symbol that stands alone is no letter
            elif not (lowered := chains.lowered[chain]).isdisjoint(token):
                gain -= SYMBOL * sum([c in lowered for c in token])
            out[chain] = gain
        out[LOST] = REPLACED * token.count("�")
        if "?" in token:
            # At the end of a word a question mark is what it seems to be.
            padded = f"\n{token}\n"
            for i, c in enumerate(padded):
                if c == "?" and (padded[i + 1].isalpha() or not any(map(str.isalpha, padded[:i]))):
                    out[LOST] += math.log(0.5 + 0.5 * math.exp(min(model.gap(padded[i - 1], padded[i + 1]), 50.0)))
        return out

    def token(self, token: str) -> tuple[np.ndarray, bool]:
        """The gains, and whether any is greater than 0."""
        known = self.kept.get(token)
        if known is None:
            gains = self.gains(token)
            if len(self.kept) >= _KEPT:
                self.kept.clear()
            known = self.kept[token] = gains, bool((gains > 0).any())
        return known

    def text(self, text: str | None) -> np.ndarray | None:
        """Evidence for each chain, over all sentences; None if no token speaks for any."""
        if not text or not suspect(text):
            return None
        tokens = [t for t in _TOKEN.findall(text) if not t.isascii() or "?" in t or "&" in t]
        if not any([self.token(t)[1] for t in set(tokens)]):
            return None
        total = np.zeros(LOST + 1)
        for sentence in _SENTENCE.split(text):
            if suspect(sentence) and (known := [self.token(t) for t in _TOKEN.findall(sentence) if not t.isascii() or "?" in t or "&" in t]):
                total += _soft(np.sum([k[0] for k in known], 0))
        return total if (total > 0).any() else None

    def repair(self, text: str, chain: int) -> str:
        """``text`` with ``chain`` undone once in the sentences that gain by it."""
        if chain == LOST:
            return text

        def undo(match: re.Match[str]) -> str:
            token = match[0]
            if not suspect(token) or token == "?":
                return token
            undone = self.chains.once(plain := html.unescape(token), chain)
            return token if undone is None or (gain := self.token(token)[0][chain]) <= 0 and len(plain) > 1 or gain < -SYMBOL else undone

        parts, at = [], 0
        for m in [*_SENTENCE.finditer(text), None]:
            sentence, end = text[at : m.start() if m else len(text)], m.end() if m else len(text)
            tokens = [t for t in _TOKEN.findall(sentence) if suspect(t)]
            if tokens and sum(self.token(t)[0][chain] for t in tokens) > MARGIN:
                sentence = _TOKEN.sub(undo, sentence)
            parts += [sentence, text[m.start() : end] if m else ""]
            at = end
        return "".join(parts)

    def undo(self, text: str, chain: int) -> tuple[list[int], str]:
        """The chains undone, the outermost first, and the result: ``chain``, then the best one that what is
        left still shows, until none is likelier than not where all are equally likely before."""
        chains, at = [chain], self.repair(text, chain)
        seen = {text, at}
        while len(seen) > len(chains) and (e := self.text(at)) is not None:
            following = int(e[:LOST].argmax())
            if e[following] <= NEXT:
                break
            further = self.repair(at, following)
            if further in seen:
                break
            chains.append(following)
            seen.add(further)
            at = further
        return chains, at


def _weigh(records: DataFrame, counts: Counts, key: str, text: str) -> DataFrame:
    """(id, grp, chain, e): the evidence of each record for each chain that anything speaks for."""
    shared, name = records.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = once(name, lambda: Evidence(shared.value))
        for batch in batches:
            rows, chains, values = [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                e = evidence.text(t)
                if e is not None:
                    some = np.flatnonzero(e > 0)
                    rows += [i] * len(some)
                    chains += some.tolist()
                    values += e[some].tolist()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("grp").take(at), pa.array(chains, pa.int32()), pa.array(values, pa.float64())], ["id", "grp", "chain", "e"])

    kind = records.schema[key].dataType.simpleString()
    return records.select(F.col(key).alias("id"), "grp", F.col(text).alias("text")).mapInArrow(run, f"id {kind}, grp string, chain int, e double")


def _estimate(evidence: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """(id, chain, posterior) by expectation–maximisation.

    Shares of chains are kept per group, drawn towards those of the whole corpus with weight POOL. Groups
    may be many and one may hold a third of all records: joins go through lookup, sums are combined first.
    """
    rows = evidence.count()
    overall = {c: 0.5 / len(NAMES) / max(total, 1) for c in range(len(NAMES))}
    cells = sums = None
    sized = cut(lookup(evidence, sizes, "grp", total=rows).withColumn("cell", F.concat_ws("\x1f", "grp", "chain")))
    for k in range(ROUNDS):
        base = F.element_at(F.create_map(*[F.lit(x) for c, p in overall.items() for x in (c, float(p))]), F.col("chain"))
        if k == 0:
            with_share = sized.withColumn("share", F.lit(0.02 / len(NAMES)))
        else:
            with_share = lookup(sized, cells, "cell", "left", total=rows).withColumn("share", (F.coalesce("r", F.lit(0.0)) + POOL * base) / (F.col("members") + POOL)).drop("r")
        # Shares of the chains a record shows no sign of stay with "clean".
        odds = with_share.withColumn("x", F.col("e") + F.log(F.greatest(F.col("share"), F.lit(1e-12))))
        norm = odds.groupBy("id").agg(F.max("x").alias("m"), F.collect_list("x").alias("xs"), F.least(F.sum("share"), F.lit(0.999)).alias("s"))
        norm = norm.select("id", "m", (F.aggregate("xs", F.lit(0.0), lambda a, x: a + F.exp(x - F.greatest("m", F.lit(0.0)))) + (1 - F.col("s")) * F.exp(-F.greatest("m", F.lit(0.0)))).alias("z"))
        posterior = odds.join(norm, "id").withColumn("posterior", F.exp(F.col("x") - F.greatest("m", F.lit(0.0))) / F.col("z"))
        if k == ROUNDS - 1:
            return posterior.select("id", "chain", "posterior")
        sums = cut(posterior.groupBy("cell", "chain").agg(F.sum("posterior").alias("r")), replaces=sums)
        cells = sums.select("cell", "r")
        found = {r.chain: r.r for r in sums.groupBy("chain").agg(F.sum("r").alias("r")).collect()}  # at most len(NAMES) rows
        overall = {c: (found.get(c, 0.0) + 0.5 / len(NAMES)) / (total + 1) for c in range(len(NAMES))}
    raise AssertionError


def garbled(records: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", field: str = "doc_kind", counts: Counts | None = None, least: float = 0.1) -> DataFrame:
    """(key, chain, posterior) of the records whose text, or a passage of it, was wrongly decoded: those
    whose posterior of having been is at least ``least``, with their most probable chain (of equal ones the first of CHAINS).

    Null and empty texts are never garbled, nor texts without a character outside ASCII, an HTML entity or a
    question mark; null sources and fields form groups of their own.
    """
    group = F.concat_ws("\x1e", F.coalesce(source, F.lit("\0")), F.coalesce(field, F.lit("\0")))
    grouped = records.withColumn("grp", group)
    counts = train(records, text) if counts is None else counts
    evidence = cut(_weigh(grouped, counts, key, text))
    sizes = cut(grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("members")))
    total = sizes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    names = F.element_at(F.array(*map(F.lit, NAMES)), 1 - F.col("b.neg"))
    return (
        _estimate(evidence, sizes, total)
        .groupBy("id")
        .agg(F.sum("posterior").alias("posterior"), F.max(F.struct(F.col("posterior").alias("p"), (-F.col("chain")).alias("neg"))).alias("b"))
        .filter(F.col("posterior") >= least)
        .select(F.col("id").alias(key), names.alias("chain"), "posterior")
    )


def repair(records: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", field: str = "doc_kind") -> DataFrame:
    """(key, chain, posterior, repaired) of the garbled records; ``repaired`` is null where nothing could be
    undone (characters lost). ``chain`` names all pairs undone, the outermost first, where a text was garbled
    by several, and a pair as often as it was undone.

    The garbled keys are counted: few are broadcast to the one scan of the texts, many joined by shuffle.
    """
    counts = train(records, text)
    found = cut(garbled(records, key, text, source, field, counts))
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    shared, name = records.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = once(name, lambda: Evidence(shared.value))
        numbers = {name: k for k, name in enumerate(NAMES)}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            undone = [evidence.undo(t, numbers[c]) for t, c in zip(texts, batch.column("chain").to_pylist())]
            chains, fixed = [", ".join(NAMES[k] for k in c) for c, _ in undone], [f for _, f in undone]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(chains, pa.string()), batch.column("posterior"), pa.array([f if f != t else None for f, t in zip(fixed, texts)], pa.string())], ["id", "chain", "posterior", "repaired"])

    kind = records.schema[key].dataType.simpleString()
    return (
        records.select(key, F.col(text).alias("text"))
        .join(side, key)
        .select(F.col(key).alias("id"), "chain", "posterior", "text")
        .mapInArrow(run, f"id {kind}, chain string, posterior double, repaired string")
        .withColumnRenamed("id", key)
    )
