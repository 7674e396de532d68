"""Cross-tokenizer alignment as joins and windows over tokens.

Both tokenizers split a text at places that no token of theirs ever spans
(``Cutter``), so a text is a sequence of units and each distinct unit needs to be
aligned once: its tokens are exploded by position, windowed sums of their lengths
give byte offsets, an equi-join on unit and end finds where both end, and a running
count of these cuts numbers the groups. Links are counted over the corpus by the
occurrences of their units. A text's row is put together from its units' rows:
frequent ones (``frequent``, at most ``HEAD``, of at most ``LONGEST`` characters)
are broadcast, all others joined by key.

Defined cases. Texts null, empty, or that the second tokenizer does not give back
byte for byte have no tokens: zeros and an empty string. Repeated rows and ids are
rows of their own, of null ids too. Very long texts are aligned whole. An empty
table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, discard

#: Frequent units that are broadcast, at most, and their length in characters.
HEAD, LONGEST = 300_000, 48
#: Share of texts, one in so many, in which frequent units are counted. Only the way
#: that a unit takes depends on it, no result does.
SAMPLED = 4
#: Rows of linked id pairs up to which their counts are broadcast; beyond, they are joined by key.
PAIRS = 2_000_000

_BLANK = "\\s\x1c-\x1f\x85\xa0"
_EDGES = frozenset(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")
#: A space that may not be cut has another or one of these beside it, or a blank that ASCII hasn't.
_PAIRS = [(c, c + " ", " " + c) for c in sorted(_EDGES - {" "})]
_RARE_BLANKS = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LETTER = re.compile(r"[^\W\d_]")


class Cutter:
    """Splits a text where neither tokenizer has a token across: into words first, each
    with the space before it, and where a word is rare into smaller units.

    The byte-level one ends a token wherever white space follows something else, at
    a single line end, and between a letter and a punctuation mark. The other may
    merge any two characters that stand side by side in one of its pieces, so a cut
    between two is used only where no piece has them."""

    def __init__(self, pieces: list[str]) -> None:
        pairs = {x + y for p in pieces for x, y in zip(p, p[1:], strict=False)}
        spaced = any(y == "▁" != x for x, y in pairs)
        lined = any("\n" in p for p in pairs)
        marks = [c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_" and not any(y == c and _LETTER.match(x) for x, y in pairs)]
        ways = []
        if not spaced:
            ways.append(f"(?<=[^{_BLANK}])(?= )")
        if not lined:
            ways += [f"(?<=[^{_BLANK}])(?=\n)", f"(?<=[^{_BLANK}]\n)(?=[^{_BLANK}])"]
        if marks:
            ways.append(f"(?<={_LETTER.pattern})(?=[{re.escape(''.join(marks))}])")
        self.split = re.compile("|".join(ways) or "(?!)").split
        self.spaced = spaced

    def words(self, text: str) -> list[str] | None:
        """The text's words, where each space before one may be cut; else None."""
        if self.spaced or text[0] in _EDGES or text[-1] in _EDGES:
            return None
        for c, after, before in _PAIRS:
            if c in text and (after in text or before in text):  # one character is found much faster than two
                return None
        if not text.isascii() and any(c in text for c in _RARE_BLANKS):
            return None
        words = text.split(" ")
        return None if "" in words else words

    def parts(self, word: str) -> list[str]:
        """The units of a word and the space before it; between letters there is no cut."""
        return [" " + word] if word.isalpha() else self.split(" " + word)


class Tokenizers:
    """The two tokenizers of a worker."""

    def __init__(self, first: str, second: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        n = self.second.piece_size()
        plain = [i for i in range(n) if not (self.second.is_byte(i) or self.second.is_control(i) or self.second.is_unknown(i))]
        self.cutter = Cutter([self.second.id_to_piece(i) for i in plain])
        second_bytes = [bytes([int(self.second.id_to_piece(i)[3:5], 16)]) if self.second.is_byte(i) else self.second.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in set(shown)]
        letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(odd)}
        vocab = self.first.get_vocab()
        first_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            if all(c in letter for c in t):
                first_bytes[i] = bytes(letter[c] for c in t)
        #: The bytes of each id of a tokenizer, and how many they are.
        self.bytes = [(side, np.array([len(x) for x in side], np.int32)) for side in (first_bytes, second_bytes)]
        self.line = self.second.encode("\n")
        self.as_is = self._as_is()

    def _as_is(self) -> bool:
        """Whether the second tokenizer's rules of normalizing are none but the space before a text."""
        try:
            from sentencepiece.sentencepiece_model_pb2 import ModelProto
        except ImportError:
            return False
        model = ModelProto.FromString(self.second.serialized_model_proto())
        rules = model.normalizer_spec
        return not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix

    def exact(self, text: str) -> bool:
        """Whether the second tokenizer sees the text as it is, with a space before it."""
        return "▁" not in text and (self.as_is or self.second.normalize(text) == "▁" + text.replace(" ", "▁"))

    def encode(self, units: pa.StringArray) -> list[pa.ListArray]:
        """Ids and their lengths in bytes, of the first and of the second, for each unit. The
        second puts a space before every text; after a line end, which it merges with nothing,
        a unit stands as it does inside a text."""
        texts = units.to_pylist()
        first = [e.ids for e in self.first.encode_batch_fast(texts, add_special_tokens=False)]
        second = [ids[len(self.line) :] for ids in self.second.encode(["\n" + u for u in texts], num_threads=1)]
        whole, ends = "".join(texts).encode(), np.cumsum(pc.binary_length(units).to_numpy(zero_copy_only=False))
        out = []
        for ids, (parts, lengths) in zip((first, second), self.bytes, strict=True):
            at = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=at[1:])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, at[-1])
            long = lengths[flat]
            # the same bytes in all, and the same end of each unit
            if b"".join([parts[i] for i in flat.tolist()]) != whole or not np.array_equal(np.append(0, np.cumsum(long))[at[1:]], ends):
                raise ValueError(f"the tokens of a unit do not give it back, among {len(texts)} from {texts[0]!r} on")
            out += [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (flat, long)]
        return out


@cache
def tokenizers(first: str, second: str) -> Tokenizers:
    return Tokenizers(first, second)


def frequent(docs: DataFrame, paths: tuple[str, str]) -> pa.ChunkedArray:
    """The units that sampled texts hold most often, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = tokenizers(*paths).cutter
        for b in batches:
            words, c = Counter(), Counter()
            for t in b.column(0).to_pylist():
                whole = cutter.words(t)
                if whole is None:
                    c.update(cutter.split(" " + t))
                else:
                    words.update(whole)
            for w, n in words.items():
                parts = cutter.parts(w)
                for u in parts if len(parts) == 1 else [" " + w, *parts]:
                    c[u] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["unit", "n"])

    texts = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).where("text <> ''").select("text")
    counted = texts.mapInArrow(run, "unit string, n long").where(F.length("unit") <= LONGEST).groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1")
    return counted.orderBy(F.desc("n"), "unit").limit(HEAD).select("unit").toArrow().column(0)


def _words(names: pa.ChunkedArray) -> tuple[list[str], list[str]]:
    """The units that a space begins, without it, and the others."""
    units = names.to_pylist()
    return [u[1:] for u in units if u[0] == " "], [u for u in units if u[0] != " "]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by 96 bits of hashes of id and text: the 64 of ``key``, and 32 that stand above
    each place (``mark``), so that rows of one key are told apart. Repeated rows are alike."""
    row = [F.col("doc_id").cast("string"), F.col("text")]
    return docs.select("doc_id", "text", F.xxhash64(*row).alias("key"), F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.lit(1), *row), 33), 32).alias("mark"))


def units(docs: DataFrame, head, paths: tuple[str, str]) -> DataFrame:
    """``unit, key, at, n``: how often each text holds a unit, and its place among the text's
    units that aren't frequent, in alphabetical order from 1 on, added to the text's mark;
    frequent ones once a task, without a key. A text that has no tokens has one row
    without a unit, at 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*paths)
        cutter = both.cutter
        words, others = head.value
        of_word, others = {w: i for i, w in enumerate(words)}, set(others)
        held, parts = np.zeros(len(words) + 1, np.int64), Counter()  # frequent words, the first for all that aren't, and other frequent units
        pack = lambda u, k, a, n: pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(k, pa.int64()), pa.array(a, pa.int64()), pa.array(n, pa.int64())], names=["unit", "key", "at", "n"])
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                unit, of, place, times, seen = [], [], [], [], []
                for t, key, mark in zip(*[batch.column(i)[at : at + 200].to_pylist() for i in range(3)], strict=True):
                    if not both.exact(t):
                        unit.append(None), of.append(key), place.append(mark), times.append(0)
                        continue
                    own, mixed = Counter(), Counter()  # rare units, and those not known to be
                    whole = cutter.words(t)
                    if whole is None:
                        mixed.update(cutter.split(" " + t))
                    else:
                        found = np.fromiter(map(of_word.get, whole, repeat(-1)), np.int32, len(whole))
                        seen.append(found)
                        for w, n in Counter([whole[i] for i in np.flatnonzero(found < 0).tolist()]).items():
                            if w.isalpha():
                                own[" " + w] = n
                            else:
                                for u in cutter.split(" " + w):
                                    mixed[u] += n
                    for u, n in mixed.items():
                        if u in others or (u[0] == " " and u[1:] in of_word):
                            parts[u] += n
                        else:
                            own[u] += n
                    names = sorted(own)
                    unit += names
                    of += [key] * len(names)
                    place += range(mark + 1, mark + 1 + len(names))
                    times += [own[u] for u in names]
                if seen:
                    held += np.bincount(np.concatenate(seen) + 1, minlength=len(held))
                yield pack(unit, of, place, times)
        for i in np.flatnonzero(held[1:]).tolist():
            parts[" " + words[i]] += int(held[i + 1])
        yield pack(list(parts), [None] * len(parts), [None] * len(parts), list(parts.values()))

    return docs.where("text <> ''").select("text", "key", "mark").mapInArrow(run, "unit string, key long, at long, n long")


def encoded(vocabulary: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``unit, n, common`` with the ids of both tokenizers and their lengths in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(*paths)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([*b.columns, *both.encode(b.column(0))], names=["unit", "n", "common", "a", "a_long", "b", "b_long"])

    return vocabulary.select("unit", "n", "common").mapInArrow(run, "unit string, n long, common boolean, a array<int>, a_long array<int>, b array<int>, b_long array<int>")


@contextmanager
def _by_unit(spark: SparkSession):
    """Lets a join on (unit, end) use rows that are dealt by unit."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def aligned(dealt: DataFrame) -> DataFrame:
    """``unit, n, common, groups, n_a, n_b, n_groups, links``: the alignment of each unit
    of ``dealt`` (``number, unit, n, common, a, a_long, b, b_long``, dealt by number)."""
    order = Window.partitionBy("number").orderBy("at")

    def placed(side: str) -> DataFrame:
        rows = dealt.select("number", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_long").alias("long"))).alias("at", "t"))
        return rows.select("number", "at", F.col("t.id").alias(side), F.sum("t.long").over(order).alias("end"))

    a, b = placed("a"), placed("b")

    def grouped(mine: DataFrame, side: str, other: DataFrame, theirs: str) -> DataFrame:
        met = mine.join(other.select("number", "end", theirs), ["number", "end"], "left")
        number = F.coalesce(F.sum(F.col(theirs).isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return met.withColumn("group", number).groupBy("number").agg(F.array_sort(F.collect_list(F.struct("at", "group", F.col(side).alias("id"), F.col(theirs).alias("other")))).alias(f"{side}_rows"))

    both = grouped(a, "a", b, "b").join(grouped(b, "b", a, "a"), "number")
    # ids of one group are joined by commas; the last one of a group has a partner
    text = lambda c: F.split(F.array_join(F.transform(c, lambda t: F.concat(t["id"].cast("string"), F.when(t["other"].isNotNull(), ";").otherwise(","))), ""), ";")
    pieces = F.zip_with(text("a_rows"), text("b_rows"), lambda x, y: F.concat(x, F.lit("|"), y))
    links = F.transform(F.filter("a_rows", lambda t: t["other"].isNotNull()), lambda t: F.struct(t["id"].alias("a"), t["other"].alias("b")))
    return both.join(dealt.select("number", "unit", "n", "common"), "number").select("unit", "n", "common", F.array_join(F.slice(pieces, 1, F.size(pieces) - 1), ";").alias("groups"), F.size("a_rows").alias("n_a"), F.size("b_rows").alias("n_b"),
                       (F.element_at("a_rows", -1)["group"] + 1).alias("n_groups"), links.alias("links"))


def pair_counts(units_of: DataFrame) -> DataFrame:
    """``a, b, count, best``: over how many occurrences each linked pair of ids stands,
    and whether no other does so more often with the same ``b``."""
    linked = units_of.select("n", F.explode("links").alias("l")).groupBy(F.col("l.a").alias("a"), F.col("l.b").alias("b")).agg(F.sum("n").alias("count"))
    return linked.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def valued(units_of: DataFrame, counts: DataFrame) -> DataFrame:
    """``unit, groups`` and the numbers of each unit: its tokens, groups and links, and
    what its links are worth."""
    found = units_of.select("unit", F.explode("links").alias("l")).join(counts, (F.col("l.a") == F.col("a")) & (F.col("l.b") == F.col("b")))
    worth = found.groupBy("unit").agg(F.count("*").alias("n_links"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    return units_of.join(worth, "unit").select("unit", "groups", *[F.col(c).cast("long").alias(c) for c in NUMBERS])


#: What is summed over the units of a text.
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Head:
    """The frequent units of a worker, by word and otherwise, made once for all its tasks."""

    made: tuple[str, Head] | None = None

    def __init__(self, words: list[str], others: list[str], groups: list[str], numbers: np.ndarray) -> None:
        self.groups, self.numbers = groups, numbers
        self.of_word = {w: i for i, w in enumerate(words)}.get
        self.other = {u: i for i, u in enumerate(others, len(words))}.get

    @classmethod
    def of(cls, held: tuple) -> Head:
        if cls.made is None or cls.made[0] != held[0]:
            cls.made = (held[0], cls(*held[1:]))
        return cls.made[1]


def gathered(docs: DataFrame, own: DataFrame, head, paths: tuple[str, str]) -> DataFrame:
    """A row for each text: its units' groups in order, and their numbers summed.
    ``own``: the rows of a text's units that are not in ``head``, by their place and mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = tokenizers(*paths).cutter
        known = Head.of(head.value)
        of_word, other, groups = known.of_word, known.other, known.groups
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                b = batch.slice(at, 100)
                texts, sums = [], np.zeros((b.num_rows, len(NUMBERS)), np.int64)
                lists = b.column(2)
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                places, strings, *numbers = lists.flatten().flatten()
                places, strings, numbers = places.to_numpy(zero_copy_only=False), strings.to_pylist(), np.stack([x.to_numpy(zero_copy_only=False) for x in numbers], axis=1).astype(np.int64)
                for row, (t, mark) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                    span = slice(int(ends[row - 1]) if row else 0, int(ends[row]))
                    mine, first = np.unique(places[span].astype(np.int64) - mark, return_index=True)
                    fits = (mine >= 0) & (mine < 1 << 32)  # rows of another text with this key are not its own
                    mine, first = mine[fits], first[fits] + span.start
                    if not t or (len(mine) and mine[0] == 0):
                        texts.append("")
                        continue
                    words = cutter.words(t)
                    found = [None] if words is None else list(map(of_word, words))
                    unknown = set()
                    if None in found:
                        pairs = [(" " + t, None)] if words is None else zip(words, found, strict=True)
                        mixed = []
                        for w, i in pairs:
                            if i is not None:
                                mixed.append(i)
                                continue
                            if words is not None and w.isalpha():
                                unknown.add(u := " " + w)
                                mixed.append(u)
                                continue
                            for u in cutter.split(w if words is None else " " + w):
                                j = of_word(u[1:]) if u[0] == " " else other(u)
                                if j is None:
                                    unknown.add(u)
                                mixed.append(u if j is None else j)
                        found = mixed
                    if unknown:
                        rare = {u: strings[i] for u, i in zip(sorted(unknown), first.tolist(), strict=True)}
                        texts.append(";".join([rare[i] if i in rare else groups[i] for i in found]))
                        found = [i for i in found if i not in rare]
                    else:
                        texts.append(";".join([groups[i] for i in found]))
                    sums[row] = known.numbers.take(np.array(found, np.int64), 0).sum(0) + numbers[first].sum(0)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *[pa.array(x) for x in np.ascontiguousarray(sums.T)]], names=["doc_id", "groups", *NUMBERS])

    void = F.array().cast("array<struct<at:long,groups:string," + ",".join(f"{c}:long" for c in NUMBERS) + ">>")
    rows = docs.join(own, "key", "left").select("doc_id", "text", F.coalesce("own", void).alias("own"), "mark")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, groups string, " + ", ".join(f"{c} long" for c in NUMBERS)
    return rows.mapInArrow(run, schema)


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """``doc_id, groups, n_a, n_b, n_groups, n_links, n_best, count_sum`` for every row:
    the text's groups of both tokenizers' ids as ``a1,a2|b1;a3|b2,b3``, and its links.
    ``first`` is a byte-level vocabulary, ``second`` a sentence-piece model."""
    spark, paths = docs.sparkSession, (first, second)
    keyed = _keyed(docs)
    names = frequent(keyed, paths)
    common = spark.sparkContext.broadcast(_words(names))
    held = cut(units(keyed, common, paths), "align-units", codec="zstd")
    vocabulary = held.where("unit is not null").groupBy("unit").agg(F.sum("n").alias("n"), F.max(F.col("key").isNull()).alias("common"))
    tokens = cut(encoded(vocabulary, paths).withColumn("number", F.monotonically_increasing_id()), "align-tokens", free=True, codec="zstd")
    dealt = tokens.repartition("number").persist(StorageLevel.MEMORY_AND_DISK)
    with _by_unit(spark):
        units_of = cut(aligned(dealt), "align-vocabulary", codec="zstd")
    dealt.unpersist()
    counts = cut(pair_counts(units_of), "align-pairs", free=True)
    if counts.count() <= PAIRS:
        counts = F.broadcast(counts)
    table = valued(units_of.where("common"), counts).toArrow()
    # words come first, and frequent ones before others, so that what is read often lies together
    other, rank = pc.invert(pc.starts_with(table["unit"], " ")), pc.index_in(table["unit"], names)
    table = table.append_column("other", other).append_column("rank", rank).sort_by([("other", "ascending"), ("rank", "ascending")])
    numbers = np.stack([table[c].to_numpy() for c in NUMBERS], axis=1).astype(np.int64) if table.num_rows else np.zeros((0, len(NUMBERS)), np.int64)
    head = spark.sparkContext.broadcast((uuid.uuid4().hex, *_words(table["unit"]), table["groups"].to_pylist(), numbers))
    rare = held.where("key is not null")
    times = [(F.col(c) * F.col("n")).alias(c) for c in NUMBERS]
    own = rare.where("unit is not null").join(valued(units_of.where("not common"), counts), "unit").select("key", "at", "groups", *times)
    void = rare.where("unit is null").select("key", "at", F.lit("").alias("groups"), *[F.lit(0).cast("long").alias(c) for c in NUMBERS])
    rows = cut(own.unionByName(void), "align-own", free=True, codec="zstd")
    discard(held, tokens, units_of)
    own = rows.groupBy("key").agg(F.collect_list(F.struct("at", "groups", *NUMBERS)).alias("own"))
    return gathered(keyed, own, head, paths)
