"""Collocations per language, by best-first branch and bound over growing phrases.

A phrase of 2 or 3 words that occurs a times is scored by its weakest cut: floor(1000000 * a * a / (l * r)), where l and
r count its two parts. Phrases grow by a word. What is known of a beginning bounds all that grow from it: a phrase that
begins with words 1 and 2 scores at most a12 / f1, because neither it nor its rest is more frequent than these; likewise
a phrase that ends with words 2 and 3 scores at most a23 / f3. A phrase of three words so needs two pairs with good
bounds, and only such triples are counted.

The frontier opens from the best bounds down, language by language. All that scores t or more is known when pairs with
bounds of t are grown, and with them everything that holds a pair of score t, which decides whether the pair survives.
A language is settled when as many phrases as wanted survive at its t, with all ties; otherwise its t goes down to eight
times as many pairs, at last to 0. t comes from histograms of scores, so no language is sorted in one task.

Words are counted as text once. From then on a word of a language is its 64-bit hash, and a text the row of its words'
hashes; that no two words share one is checked, and otherwise other hashes are taken. Tasks count n-grams of a stretch
before the shuffle. Most pairs are rare, so pairs are counted by a hash of both first, and then exactly only those
whose hash comes often enough. Tasks know frequent words, frequent pairs and the frontier by bitmaps of hashes, whose size is
bounded: a pair that is taken for another one costs a count that isn't needed, and changes no result. All counts
and scores are exact. Counts of parts are joined; the few parts that make up a thousandth of all words or more are
broadcast, so no task of the join gets a hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import as_batch, bytes_of, mixed, written

#: Keys that a task holds before it counts them, distinct words, rows that it sends at once, and words of a row of hashes.
FLUSH, FLUSH_WORDS, SENT, ROW_WORDS = 1 << 19, 1 << 17, 1 << 15, 1 << 16
#: Texts that a task copies out of a batch at once.
TEXTS = 256
#: Bits of a bitmap: eight for each hash, and at most so many (16 MB).
LEAST_BITS, MOST_BITS = 13, 27
#: Rows of the frontier's first step, in multiples of the limit, and how many times as many each further step takes.
FIRST, STEP = 2, 8
#: A part with this share of all words or more is broadcast: so there are at most so many.
HOT_PARTS = 1000
#: Groups in which a language is ranked first.
GROUPS = 32
SCALE = 1_000_000

#: Ends of pieces become one sign, which no word holds, A-Z become a-z.
MARK = b"."
PIECES = bytes(0x2E if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def pieces(text: bytes) -> list[bytes]:
    """Words of a text, with marks between its pieces."""
    return text.translate(PIECES).replace(MARK, b" . ").split()


def _joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs."""
    return mixed(a ^ mixed(b + np.uint64(0x9E3779B97F4A7C15)))


class WordHashes(dict):
    """Hashes of a language's words, remembered; 0 is the mark."""

    def __init__(self, lang: str, seed: int):
        self.start = xxhash.xxh64_intdigest(lang.encode(), seed)
        self[MARK] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) >= FLUSH_WORDS:
            self.clear()
            self[MARK] = 0
        self[word] = out = xxhash.xxh64_intdigest(word, self.start) or 1
        return out


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, text) of all rows; a batch isn't copied as a whole."""
    for batch in batches:
        for a in range(0, batch.num_rows, TEXTS):
            part = batch.slice(a, TEXTS)
            yield from zip(part.column("lang").to_pylist(), bytes_of(part.column("text")), strict=True)


class Bitmap:
    """A set of hashes, and some others by mistake."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits = bits
        raw = np.zeros(1 << bits - 3, np.uint8)
        for b, x in blocks.items():
            raw[b << LEAST_BITS - 3 : b + 1 << LEAST_BITS - 3] = np.frombuffer(x, np.uint8)
        self.raw = raw

    def __contains__(self, h: int) -> bool:
        return bool(self.of(np.array([h], np.uint64))[0])

    def of(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.raw[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def placed(hashes: DataFrame, bits: int) -> DataFrame:
    """(block, at): bits of a bitmap that rows (h), or (h1, h2) of pairs, set; one pass through Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [c.to_numpy().view(np.uint64) for c in batch.columns]
            h = parts[0] if len(parts) == 1 else _joint(*parts)
            at = np.unique(h >> np.uint64(64 - bits)).astype(np.int64)
            yield as_batch({"block": pa.array(at >> LEAST_BITS), "at": pa.array((at & (1 << LEAST_BITS) - 1).astype(np.int16))})

    return hashes.mapInArrow(run, "block long, at short")


def bitmap(hashes: DataFrame) -> Bitmap:
    """Of rows (h), or (h1, h2) of pairs: made in blocks on executors; at most 2^MOST_BITS bits reach the driver."""
    bits = min(max((8 * hashes.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def merged(group: pa.Table) -> pa.Table:
        block = np.zeros(1 << LEAST_BITS, np.uint8)
        block[group.column("at").to_numpy()] = 1
        return pa.table({"block": group.column("block")[:1], "bits": pa.array([np.packbits(block, bitorder="little").tobytes()], pa.binary())})

    dealt = placed(hashes, bits).distinct().groupBy("block")
    return Bitmap(bits, {r.block: bytes(r.bits) for r in dealt.applyInArrow(merged, "block long, bits binary").collect()})


def counted_words(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, w, h, n) of all words."""

    def emitted(lang: str, hashes: WordHashes, counts: dict) -> Iterator[pa.RecordBatch]:
        words = list(counts)
        for a in range(0, len(words), SENT):
            own = words[a : a + SENT]
            yield as_batch(
                {
                    "lang": pa.array([lang] * len(own)),
                    "w": pa.array(own, pa.binary()).cast(pa.string()),
                    "h": pa.array(np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own)).view(np.int64)),
                    "n": pa.array([counts[w] for w in own], pa.int64()),
                }
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        hashes: dict[str, WordHashes] = {}
        for lang, text in texts_of(batches):
            own = counts.setdefault(lang, Counter())
            own.update(pieces(text))
            own.pop(MARK, None)
            if len(own) >= FLUSH_WORDS:
                yield from emitted(lang, hashes.setdefault(lang, WordHashes(lang, seed)), counts.pop(lang))
        for lang, own in counts.items():
            yield from emitted(lang, hashes.setdefault(lang, WordHashes(lang, seed)), own)

    return texts.mapInArrow(run, "lang string, w string, h long, n long").groupBy("lang", "w", "h").agg(F.sum("n").alias("n"))


def hashed_texts(texts: DataFrame, frequent: Bitmap, seed: int) -> DataFrame:
    """(lang, size, words): hashes of texts' words, compressed; 0 for marks, rare words, and between texts."""

    def packed(lang: str, held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate([*held, np.zeros(1, np.uint64)])
        h[~frequent.of(h)] = 0
        data = pa.compress(h.tobytes(), codec="zstd", asbytes=True)
        return as_batch({"lang": pa.array([lang]), "size": pa.array([len(h)], pa.int64()), "words": pa.array([data], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, WordHashes] = {}
        held: dict[str, list[np.ndarray]] = {}
        size: Counter = Counter()
        for lang, text in texts_of(batches):
            own = hashes.setdefault(lang, WordHashes(lang, seed))
            words = [MARK, *pieces(text)]
            held.setdefault(lang, []).append(np.fromiter(map(own.__getitem__, words), np.uint64, len(words)))
            size[lang] += len(words)
            if size[lang] >= ROW_WORDS:
                yield packed(lang, held.pop(lang))
                size[lang] = 0
        for lang, own_rows in held.items():
            yield packed(lang, own_rows)

    return texts.mapInArrow(run, "lang string, size long, words binary")


class _Hashes:
    """Pairs of frequent words, as hashes of both."""

    names = ("h",)

    def keys(self, h: np.ndarray) -> list[np.ndarray]:
        at = np.flatnonzero((h[:-1] != 0) & (h[1:] != 0))
        return [_joint(h[at], h[at + 1])]


class _Pairs:
    """Pairs of a bitmap."""

    names: tuple[str, ...] = ("h1", "h2")

    def __init__(self, wanted: Bitmap):
        self.wanted = wanted

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((h[:-1] != 0) & (h[1:] != 0))
        joint = _joint(h[at], h[at + 1])
        some = self.wanted.of(joint)
        return at[some], joint[some]

    def keys(self, h: np.ndarray) -> list[np.ndarray]:
        at, _ = self.places(h)
        return [h[at], h[at + 1]]


class _Triples(_Pairs):
    """Triples on the frontier: of two pairs that may be grown, or around a pair whose survival is at stake."""

    names = ("h1", "h2", "h3")

    def __init__(self, pairs: _Pairs, begins: Bitmap, ends: Bitmap, staked: Bitmap):
        super().__init__(pairs.wanted)
        self.begins, self.ends, self.staked = begins, ends, staked

    def keys(self, h: np.ndarray) -> list[np.ndarray]:
        pair, joint = self.places(h)
        next_to = np.flatnonzero(pair[1:] == pair[:-1] + 1)
        a, b = joint[next_to], joint[next_to + 1]
        some = self.begins.of(a) & self.ends.of(b) | self.staked.of(a) | self.staked.of(b)
        at = pair[next_to[some]]
        return [h[at], h[at + 1], h[at + 2]]


def _unique(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and how often they occur."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def counted(rows: DataFrame, grams: _Hashes | _Pairs) -> DataFrame:
    """(h, n), (h1, h2, n) or (h1, h2, h3, n): how often the wanted n-grams occur inside pieces."""
    names = grams.names

    def emitted(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, n = _unique([np.concatenate(c) for c in zip(*held)])
        for a in range(0, len(n), SENT):
            yield as_batch({k: pa.array(c[a : a + SENT]) for k, c in zip([*names, "n"], [*(c.view(np.int64) for c in keys), n])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for n, data in zip(batch.column("size").to_pylist(), batch.column("words")):  # rows are large: no copy of a batch
                h = np.frombuffer(pa.decompress(data.as_buffer(), decompressed_size=8 * n, codec="zstd"), np.uint64)
                held.append(grams.keys(h))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield from emitted(held)
                    held, size = [], 0
        if size:
            yield from emitted(held)

    kind = ", ".join(f"{k} long" for k in (*names, "n"))
    # Tasks have counted already, and most keys are rare: no second table of them before the shuffle.
    dealt = rows.select("size", "words").mapInArrow(run, kind).repartition(*names)
    return dealt.groupBy(*names).agg(F.sum("n").alias("n"))


def with_counts(df: DataFrame, counts: DataFrame, keys: dict[str, str], name: str, total: int, *more: str) -> DataFrame:
    """df with the counts of its parts, as column name, and more of their columns; keys: columns of df by columns of counts.

    Both are tables. Counts sum up to total at most, so the parts that are hot are few and are broadcast; other keys bring at
    most total / HOT_PARTS rows each. Rows without a counted part are dropped.
    """
    renamed = counts.select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("n").alias(name), *more)
    on = [F.col(k) == F.col(f"_{c}") for c, k in keys.items()]
    hot = F.col(name) * HOT_PARTS >= total
    few = F.broadcast(renamed.where(hot))
    cold = df.join(few.drop(name, *more), on, "left_anti").join(renamed.where(~hot), on)
    return df.join(few, on).unionByName(cold).drop(*(f"_{c}" for c in keys))


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact for counts below 10^15."""
    wide = "decimal(15,0)"
    product = a.cast(wide) * a.cast(wide) * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", product, left.cast(wide) * right.cast(wide))


def step_of(scores: DataFrame, rows: Column | int) -> DataFrame:
    """(lang, least): the highest score that, with those above it, as many rows of (lang, score) have; 0 if there are fewer.

    At most SCALE + 1 scores of a language are ordered in one task.
    """
    per_score = scores.groupBy("lang", "score").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")))
    enough = F.when(upto >= rows, F.col("score"))
    ranked = per_score.withColumn("enough", enough)
    return ranked.groupBy("lang").agg(F.coalesce(F.max("enough"), F.lit(0)).cast("long").alias("least"))


def _scored_pairs(pairs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    both = with_counts(pairs, words, {"h": "h1"}, "l", total, "lang")
    both = with_counts(written(both, "pairs-left"), words, {"h": "h2"}, "r", total)
    return both.select(
        *("lang", "h1", "h2", F.col("n").alias("a"), "l", "r"),
        score_of(F.col("n"), F.col("l"), F.col("r")).alias("score"),
        F.expr(f"n * {SCALE} div l").alias("begin_bound"),
        F.expr(f"n * {SCALE} div r").alias("end_bound"),
    )


def _scored_triples(triples: DataFrame, pairs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """The cut that scores least, of equal ones the first, with the counts of its parts."""
    triples = written(with_counts(triples, words, {"h": "h1"}, "l1", total, "lang"), "triples-1")
    triples = written(with_counts(triples, words, {"h": "h3"}, "r2", total), "triples-2")
    triples = written(with_counts(triples, pairs, {"h1": "h2", "h2": "h3"}, "r1", total), "triples-3")
    triples = with_counts(triples, pairs, {"h1": "h1", "h2": "h2"}, "l2", total)
    s1, s2 = score_of(F.col("n"), F.col("l1"), F.col("r1")), score_of(F.col("n"), F.col("l2"), F.col("r2"))
    cut = triples.withColumn("s1", s1).withColumn("s2", s2).withColumn("first", F.col("s1") <= F.col("s2"))

    def chosen(a: str, b: str) -> Column:
        return F.when(F.col("first"), F.col(a)).otherwise(F.col(b))

    return cut.select(
        *("lang", "h1", "h2", "h3", F.col("n").alias("a")),
        chosen("l1", "l2").alias("l"),
        chosen("r1", "r2").alias("r"),
        chosen("s1", "s2").alias("score"),
    )


def _survivors(pairs: DataFrame, triples: DataFrame, share: int) -> DataFrame:
    """Phrases that no longer candidate holds as often as to drop them. Nothing is longer than three words."""
    inside = triples.select("h1", "h2", "a").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))
    longer = inside.groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    left = pairs.join(longer, ["h1", "h2"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    shown = ["lang", "h1", "h2", "h3", "a", "l", "r", "score"]
    return left.withColumn("h3", F.lit(None).cast("long")).select(*shown).unionByName(triples.select(*shown))


def collocations(docs: DataFrame, limit: int = 2000, least: int = 10, share: int = 50, report: Callable[[list], None] | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, a (both descending), and phrase.

    Words are parted by blanks and tabs inside pieces of the lowered text. Candidates have 2 or 3 words and occur least times
    or more in texts of the language; one whose words lie inside a longer candidate with share percent of its
    occurrences or more is dropped. n counts the language's words. A null lang is `und`; null and empty texts have no
    words; repeated rows count as often as they come; a language without survivors has no rows. A long text is read as a
    whole. Other columns are ignored, also those named like results. report gets what each step of the frontier found.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    seed, shared = -1, True
    while shared:  # two words of one hash: hardly ever
        seed += 1
        every = written(counted_words(texts, seed), "words")
        shared = every.groupBy("h").count().where("count > 1").limit(1).count() > 0
    totals = written(every.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = written(every.where(F.col("n") >= least), "frequent")
    rows = written(hashed_texts(texts, bitmap(words.select("h")), seed), "hashed-texts")
    often = written(counted(rows, _Hashes()).where(F.col("n") >= least).select("h"), "pair-hashes")
    known_pairs = _Pairs(bitmap(often))
    counts = written(counted(rows, known_pairs).where(F.col("n") >= least), "pairs")
    pairs = written(_scored_pairs(counts, words, total), "scored-pairs")

    # One row per language reaches the driver here and below.
    open_ = [r.lang for r in totals.select("lang").collect()]
    wanted, done, steps = FIRST * limit, [], []
    while open_:
        own = pairs.where(F.col("lang").isin(open_))
        at = {x: 0 for x in open_} | {r.lang: r["least"] for r in step_of(own.select("lang", "score"), wanted).collect()}
        floor = docs.sparkSession.createDataFrame(list(at.items()), "lang string, least long")
        front = own.join(F.broadcast(floor), "lang").where(F.greatest("begin_bound", "end_bound", "score") >= F.col("least"))
        front = written(front, "frontier")
        begins, ends, staked = (
            bitmap(front.where(F.col(c) >= F.col("least")).select("h1", "h2")) for c in ("begin_bound", "end_bound", "score")
        )
        grown = counted(rows.where(F.col("lang").isin(open_)), _Triples(known_pairs, begins, ends, staked)).where(F.col("n") >= least)
        triples = _scored_triples(written(grown, "triples"), counts, words, total)
        staked_pairs = front.where(F.col("score") >= F.col("least")).drop("least")
        known = _survivors(staked_pairs, triples, share).join(F.broadcast(floor), "lang").where(F.col("score") >= F.col("least"))
        known = written(known.drop("least"), "survivors")
        found = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
        settled = [x for x in open_ if found.get(x, 0) >= limit or at[x] == 0]
        steps.append({x: (at[x], found.get(x, 0)) for x in open_})
        done.append(known.where(F.col("lang").isin(settled)))
        open_ = [x for x in open_ if x not in settled]
        wanted *= STEP
    if report is not None:
        report(steps)
    if not done:
        return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    settled_rows = done[0]
    for x in done[1:]:
        settled_rows = settled_rows.unionByName(x)
    return ranked(settled_rows, words, totals, limit, total)


def ranked(rows: DataFrame, words: DataFrame, totals: DataFrame, limit: int, total: int) -> DataFrame:
    """The first rows of each language: those that reach the score of the last of them, ranked in groups, then together."""
    last = step_of(rows.select("lang", "score"), limit)
    near = rows.join(F.broadcast(last), "lang").where(F.col("score") >= F.col("least"))
    near = near.withColumn("id", F.monotonically_increasing_id())
    parts = F.posexplode(F.array_compact(F.array("h1", "h2", "h3"))).alias("at", "h")
    spelled = with_counts(written(near, "near").select("*", parts), words, {"h": "h"}, "_n", total, "w")
    by_place = F.transform(F.sort_array(F.collect_list(F.struct("at", "w"))), lambda x: x["w"])
    phrases = spelled.groupBy("id", "lang", "a", "l", "r", "score").agg(F.array_join(by_place, " ").alias("phrase"))
    by = [F.desc("score"), F.desc("a"), F.col("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)).alias("_group")
    first = phrases.select("*", group).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_group").orderBy(*by)))
    top = first.where(F.col("rank") <= limit).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)))
    named = top.where(F.col("rank") <= limit).join(F.broadcast(totals), "lang")
    return named.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
