"""Problem 4: same or near-same records across splits.

Exact: the words of prompt and completion (runs of letters and digits, without case, punctuation
and spacing) are hashed; evaluation hashes are joined with training hashes. All rows with one hash
are one class; everything below works on classes and expands to rows at the end.

Almost: prompts and completions must each agree in at least nine of ten words of the longer text,
in the same order (longest common subsequence). Two texts that do so share at least that many of
their words as bags, so in any common order of words each has one of the other's among its first
n - ceil(0.9 n) + 1 words. The order puts rare words first. A record of few words is keyed by every
pair of one such word of its prompt and one of its completion; a longer one by those of its longer
field alone, so that keys grow in proportion to a text. Records near either border are keyed both
ways, as far as their lengths may differ: a pair always has a way in common. Equal keys across the
splits are candidates.
Those whose words can't agree in number are dropped by a bitmap of the words of either text: every
bit in which two bitmaps differ takes a word that only one text has. The exact measure confirms
the rest. No pair is lost, and the order only decides how few candidates there are: it comes from
the counts of words over all rows, of which those that make up at least 1 / `ranked_words` of all
words are told apart, the others coming first by their hash.

A completion that is empty by problem 3 makes no case. Null prompts count as texts without words;
two texts without words are the same. Rows delivered twice are rows of their own: every pair of
one train row and one evaluation row is given. Rows whose split is neither are ignored, as are
extra columns; an empty table gives no rows. Texts of any length are compared whole.
"""

from __future__ import annotations

import array
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lontar.llm.emptiness import is_empty
from lontar.operators.spread import salted_join
from lontar.runtime import materialize

WORD = re.compile(r"[^\W_]+")
SHARE = (9, 10)
#: Records of fewer words than this are keyed by pairs of words, others by words of one field.
JOINT_WORDS = 120
#: Texts whose repetition a task remembers; others are keyed again, which only costs a row.
REMEMBERED = 100_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def needed(n: int, share: tuple[int, int] = SHARE) -> int:
    """The least common words of a text of n words with one no longer."""
    return -(-n * share[0] // share[1])


def common_in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        at = places.get(w)
        if at:
            hit = row & at
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def almost_same(a: list[str], b: list[str], share: tuple[int, int] = SHARE) -> bool:
    if a == b:
        return True
    longer = max(len(a), len(b))
    least = needed(longer, share)
    return min(len(a), len(b)) >= least and common_in_order(a, b) >= least


def _word_order(w: str, rank: int) -> int:
    """Place of a word in the common order: frequent ones last, by rank; others by hash."""
    return (rank << 64) | xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))


def word_ranks(rows: DataFrame, keep: int) -> dict[str, int]:
    """The words that make up at least 1 / `keep` of all words, ranked from the rarest; counted over
    all rows. There are at most `keep` of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for column in (0, 1):
                for at in range(0, batch.num_rows, 500):
                    texts = [x for x in batch.column(column).slice(at, 500).to_pylist() if x]
                    seen.update(WORD.findall("\n".join(texts).lower()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = rows.select("prompt", "completion").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted, _ = materialize(counted)
    total = counted.agg(F.sum("n")).first()[0] or 0
    top = counted.where(F.col("n") * keep >= total).collect()
    return {r.word: i for i, r in enumerate(sorted(top, key=lambda r: (r.n, r.word)), 1)}


class Signer:
    """Hash, sizes and join keys of a record."""

    def __init__(self, ranks: dict[str, int], share: tuple[int, int]):
        self.ranks, self.share = ranks, share
        self.places: dict[str, int] = {}

    def place(self, w: str) -> int:
        found = self.places[w] = _word_order(w, self.ranks.get(w.partition(" ")[0], 0))
        return found

    def leading(self, listed: list[str]) -> list[int]:
        """The first words of a text in the common order; repeated words are numbered."""
        size = len(listed)
        take = size - needed(size, self.share) + 1
        places, get = [], self.places.get
        counted: Counter[str] | None = Counter(listed) if len(set(listed)) < size else None
        if counted is None:
            tokens = listed
        else:
            tokens = [w if k == 0 else f"{w} {k}" for w, n in counted.items() for k in range(n)]
        for w in tokens:
            places.append(get(w) or self.place(w))
        places.sort()
        mask = (1 << 64) - 1
        return [x & mask for x in places[:take]]

    def bitmap(self, listed: list[str]) -> int:
        """32 bits, set by the hashes of the words."""
        bits, get = 0, self.places.get
        for w in set(listed):
            bits |= 1 << ((get(w) or self.place(w)) >> 17 & 31)
        return bits

    def keys(self, p: list[str], c: list[str]) -> list[int]:
        """The join keys of a record; two records that agree have one in common."""
        (x, y), total, lead_p, lead_c = self.share, len(p) + len(c), None, None
        out: list[int] = []
        if total * x <= JOINT_WORDS * y:
            lead_p, lead_c = self.leading(p), self.leading(c)
            out += [_mixed(a, b) for a in lead_p for b in lead_c]
        if total >= JOINT_WORDS:
            if len(c) * y * y >= len(p) * x * x:
                out += [_mixed(1, b) for b in lead_c or self.leading(c)]
            if len(p) * y * y >= len(c) * x * x:
                out += [_mixed(a, 2) for a in lead_p or self.leading(p)]
        return out

    def sign(self, prompt: str | None, completion: str | None, known: dict[int, None]) -> tuple[int, int, int, int, list[int]]:
        """(two halves of the hash, numbers of words, bitmaps, keys); no keys for what is `known`."""
        p, c = words(prompt) or [""], words(completion) or [""]
        digest = xxhash.xxh128_intdigest("\n".join((" ".join(p), " ".join(c))).encode("utf-8", "surrogatepass"))
        if len(self.places) > 300_000:
            self.places.clear()
        seen = digest in known
        if not seen and len(known) < REMEMBERED:
            known[digest] = None
        keys = [] if seen else self.keys(p, c)
        bits = 0 if seen else self.bitmap(p) << 32 | self.bitmap(c)
        return (digest >> 64) - _HALF, (digest & _MASK) - _HALF, len(p) << 32 | len(c), bits - (bits >> 63 << 64), keys


_MASK, _HALF = (1 << 64) - 1, 1 << 63


def _mixed(a: int, b: int) -> int:
    return ((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & _MASK) - _HALF


def signed(rows: DataFrame, share: tuple[int, int], ranked_words: int) -> DataFrame:
    """(id, side, h1, h2, sizes, bits, keys); completions that are empty are left out. A text that a
    task meets again has no keys: its first row has them."""
    picked = rows.select("id", "prompt", "completion", F.when(F.col("split") == "train", 0).when(F.col("split").isin("validation", "test"), 1).alias("side")).where("side is not null")
    kind = picked.schema["id"].dataType.simpleString()
    ranks = rows.sparkSession.sparkContext.broadcast(word_ranks(picked, ranked_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, known = Signer(ranks.value, share), ({}, {})
        for batch in batches:
            out, flat, offsets = tuple([] for _ in range(6)), array.array("q"), array.array("i", [0])
            for i, p, c, side in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if is_empty(c):
                    continue
                *cells, keys = signer.sign(p, c, known[side])
                for column, cell in zip(out, (i, side, *cells)):
                    column.append(cell)
                flat.extend(keys)
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(
                pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]),
                pa.Array.from_buffers(pa.int64(), len(flat), [None, pa.py_buffer(flat)]),
            )
            types = (batch.schema.field(0).type, pa.int32(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(out, types)], lists], names=["id", "side", "h1", "h2", "sizes", "bits", "keys"])

    return picked.mapInArrow(run, f"id {kind}, side int, h1 long, h2 long, sizes long, bits long, keys array<long>")


def _may_agree(share: tuple[int, int]) -> Column:
    """Whether the texts of two keyed classes can have enough words in common."""
    x, y = share
    differ = F.col("bits").bitwiseXOR(F.col("other_bits"))
    result, low = F.lit(True), F.lit((1 << 32) - 1)
    for part in (lambda c: F.shiftrightunsigned(c, 32), lambda c: c.bitwiseAND(low)):
        n, m = part(F.col("sizes")), part(F.col("other_sizes"))
        least = F.floor((F.greatest(n, m) * x + (y - 1)) / y)
        result &= (F.least(n, m) >= least) & (F.bit_count(part(differ)) <= n + m - 2 * least)
    return result


def class_links(rows: DataFrame, share: tuple[int, int] = SHARE, ranked_words: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The rows with their class (id, side, h1, h2), and the links (h1, h2, g1, g2) between a class
    that stands in train and one that stands in evaluation; a class on both sides links to itself."""
    members, _ = materialize(signed(rows, share, ranked_words))

    def keyed(side: int, names: list[str]) -> DataFrame:
        # a key and its class meet in one partition, where repeated classes are dropped before the join
        spread = members.where(F.col("side") == side).select(F.explode("keys").alias("key"), "h1", "sizes", "bits").toDF("key", *names)
        return spread.repartition("key").dropDuplicates(["key", names[0]])

    # half of a hash is enough for candidates: two classes that share it are both compared
    a = keyed(0, ["a", "sizes", "bits"])
    b = keyed(1, ["b", "other_sizes", "other_bits"])
    pairs, _ = materialize(a.join(b, "key").where((F.col("a") != F.col("b")) & _may_agree(share)).select("a", "b").distinct())
    # a class is compared by the text of its smallest row; only the rows of candidates are read on
    train = _representatives(members, 0, pairs.select(F.col("a").alias("h1"))).toDF("a", "h2", "ta")
    other = _representatives(members, 1, pairs.select(F.col("b").alias("h1"))).toDF("b", "g2", "tb")
    both, _ = materialize(pairs.join(train, "a").join(other, "b"))
    wanted, _ = materialize(both.select(F.col("ta").alias("id")).unionByName(both.select(F.col("tb").alias("id"))).distinct())
    texts, _ = materialize(rows.select("id", "prompt", "completion").join(wanted, "id", "left_semi"))
    compared = both.join(texts.toDF("ta", "pa", "ca"), "ta").join(texts.toDF("tb", "pb", "cb"), "tb")

    @F.pandas_udf("boolean")
    def confirmed(p: pd.Series, c: pd.Series, q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([almost_same(words(e), words(g), share) and almost_same(words(f), words(h), share) for e, f, g, h in zip(p, c, q, d)], dtype="bool")

    close = compared.where(confirmed("pa", "ca", "pb", "cb")).select(F.col("a").alias("h1"), "h2", F.col("b").alias("g1"), "g2").distinct()
    sides = members.groupBy("h1", "h2").agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low <> high")
    links, _ = materialize(close.unionByName(sides.select("h1", "h2", F.col("h1").alias("g1"), F.col("h2").alias("g2"))))
    return members.select("id", "side", "h1", "h2"), links


def _representatives(members: DataFrame, side: int, wanted: DataFrame) -> DataFrame:
    """(h1, h2, id) of the smallest row of each class of a side that is wanted."""
    own = members.where(F.col("side") == side).select("h1", "h2", "id").join(wanted.distinct(), "h1", "left_semi")
    return own.groupBy("h1", "h2").agg(F.min("id").alias("id"))


def _linked(members: DataFrame, side: int, names: list[str], links: DataFrame) -> DataFrame:
    """The rows of a side whose class has a link."""
    own = members.where(F.col("side") == side).select(F.col("h1").alias(names[0]), F.col("h2").alias(names[1]), F.col("id").alias(names[2]))
    return own.join(links.select(names[:2]).distinct(), names[:2], "left_semi")


def overlaps(rows: DataFrame, share: tuple[int, int] = SHARE, ranked_words: int = 100_000) -> DataFrame:
    """(id_a, id_b), the smaller id first, of every overlap between train and evaluation."""
    members, links = class_links(rows, share, ranked_words)
    train, other = _linked(members, 0, ["h1", "h2", "ta"], links), _linked(members, 1, ["g1", "g2", "tb"], links)
    found = salted_join(salted_join(links, train, ["h1", "h2"], "ta"), other, ["g1", "g2"], "tb")
    return found.select(F.least("ta", "tb").alias("id_a"), F.greatest("ta", "tb").alias("id_b")).distinct()


def overlap_counts(rows: DataFrame, share: tuple[int, int] = SHARE, ranked_words: int = 100_000) -> DataFrame:
    """(id, class_id, links) of every evaluation row that overlaps train: `links` counts the train
    rows, without listing pairs, so that repeated texts cost one row each."""
    members, links = class_links(rows, share, ranked_words)
    sizes = _linked(members, 0, ["h1", "h2", "ta"], links).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    per_class = links.join(sizes, ["h1", "h2"]).groupBy("g1", "g2").agg(F.sum("n").alias("links"))
    found = salted_join(per_class, _linked(members, 1, ["g1", "g2", "id"], links), ["g1", "g2"], "id")
    return found.select("id", F.format_string("%016x%016x", "g1", "g2").alias("class_id"), "links")
