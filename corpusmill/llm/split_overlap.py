"""Same or near-same texts across splits, by a compressed full-text index of the evaluation texts."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.near_duplicates import SETS, SIDE, apart, close_sets, sets_of_texts
from corpusmill.llm.shingles import WordIds, distinct, least_overlap, shingle_batch, shingles_at, token_batch
from corpusmill.runtime import new_path, stage, unstage

SHARD_WORDS = 4_000_000
SKETCH_BITS = 1024
#: Words of a stretch that is searched by itself; matches that pass its end are cut there and merged again. Tasks over which the training texts of a shard are spread.
STRETCH, SPREAD = 512, 16


def _write(path: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Each array as a compressed file of its own; complete files only ever appear under their names."""
    url = urlparse(path)
    packed = {}
    for k, a in arrays.items():
        b = io.BytesIO()
        np.save(b, a)
        packed[k] = zstandard.ZstdCompressor(level=3).compress(b.getbuffer())
    if url.scheme in ("", "file"):
        folder = url.path
        os.makedirs(folder, exist_ok=True)
        for k, raw in packed.items():
            tmp = f"{folder}/.{name}-{k}-{uuid.uuid4().hex}"
            with open(tmp, "wb") as f:
                f.write(raw)
            os.replace(tmp, f"{folder}/{name}-{k}.zst")
        return
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(path)
    system.create_dir(base, recursive=True)
    for k, raw in packed.items():
        with system.open_output_stream(f"{base}/{name}-{k}.zst") as out:
            out.write(raw)


def _read(path: str, name: str, k: str) -> np.ndarray:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        with open(f"{url.path}/{name}-{k}.zst", "rb") as f:
            raw = f.read()
    else:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path)
        with system.open_input_stream(f"{base}/{name}-{k}.zst") as f:
            raw = f.read()
    return np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(raw)))


def _suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of t sorted by the `depth` symbols or more from each on; prefix doubling, which ends early where all suffixes differ."""
    rank = t.astype(np.int64)
    length = 1
    while length < depth:
        nxt = np.zeros(len(t), np.int64)
        nxt[: len(t) - length] = rank[length:] + 1
        both = rank * (int(rank.max(initial=0)) + 2) + nxt
        order = np.argsort(both, kind="stable")
        step = np.concatenate([[0], np.cumsum(both[order][1:] != both[order][:-1])])
        rank = np.empty(len(t), np.int64)
        rank[order] = step
        length *= 2
        if len(t) and step[-1] == len(t) - 1:
            return order
    return np.argsort(rank, kind="stable")


def _least_dtype(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint16 if a.max(initial=0) < 1 << 16 else np.int32)


class WordIndex:
    """A word-level FM-index of some texts: counts and finds runs of words of any length by backward search, for arrays of queries at once.

    vocab: the words' numbers, sorted; symbol of a word is its place + 1, and 0 ends a text. spots: the Burrows-Wheeler transform as the
    places of each symbol, symbol by symbol; in memory they are keys symbol * (n + 1) + place, in which a search for a symbol and a place gives the
    next interval's bound. doc: the text of each suffix. first: where each symbol's suffixes begin. text, start: the texts and where each
    begins. Numbers are kept in two or four bytes and compressed: some five bytes a word, less than the text itself.
    """

    PARTS = ("vocab", "spots", "doc", "first", "text", "start", "key", "size", "sketch")

    def __init__(self, part):
        for k in self.PARTS:
            setattr(self, k, part(k))
        self.n = len(self.text)
        self.last = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first)) * (self.n + 1) + self.spots

    @classmethod
    def build(cls, tokens: np.ndarray, offsets: np.ndarray, keys: np.ndarray, sizes: np.ndarray, sketches: np.ndarray) -> dict[str, np.ndarray]:
        vocab, symbol = np.unique(tokens, return_inverse=True)
        n_docs = len(offsets) - 1
        n = len(tokens) + n_docs
        text = np.zeros(n, np.int32)
        doc_of = np.repeat(np.arange(n_docs), np.diff(offsets))
        text[np.arange(len(tokens)) + doc_of] = symbol + 1
        start = offsets[:-1] + np.arange(n_docs)
        order = _suffix_order(text, int(np.diff(offsets).max(initial=0)) + 1)
        last = text[order - 1].astype(np.int64)
        doc = np.searchsorted(start, order, side="right") - 1
        first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(vocab) + 1))])
        spots = np.argsort(last, kind="stable").astype(np.int32)
        return {"vocab": vocab, "spots": spots, "doc": _least_dtype(doc), "first": first, "text": _least_dtype(text), "start": np.append(start, n), "key": keys, "size": sizes, "sketch": sketches}

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """The symbol of each word, -1 for words that no text has."""
        at = np.searchsorted(self.vocab, words)
        known = at < len(self.vocab)
        known[known] = np.asarray(self.vocab)[at[known]] == words[known]
        return np.where(known, at + 1, -1)

    def maximal(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(stretch, begin, end, lo, hi) of matches of k words or more of the stretches [begin, end) of symbols: none can be longer to the left within its stretch, and every run of k words that some text has lies within one. [lo, hi) are the suffixes that begin with the match.

        All stretches go backward in step. Where a match ends at a word that can't go before it, the next one starts k - 1 words
        to the right of that word: a run of k words that begins at the word or before it ends there at the latest.
        """
        e, s = end - 1, end - 1
        lo, hi = np.zeros(len(e), np.int64), np.full(len(e), self.n, np.int64)
        alive = np.flatnonzero(end - begin >= k)
        found = []
        while len(alive):
            c = np.where(s[alive] >= begin[alive], symbols[np.maximum(s[alive], 0)], 0)
            can = c > 0
            new_lo, new_hi = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64)
            if can.any():
                new_lo[can], new_hi[can] = self.extend(c[can], lo[alive[can]], hi[alive[can]])
            on = new_hi > new_lo
            go = alive[on]
            lo[go], hi[go] = new_lo[on], new_hi[on]
            s[go] -= 1
            stop, word = alive[~on], c[~on]
            if len(stop):
                long = e[stop] - s[stop] >= k
                found.append((stop[long], s[stop[long]] + 1, e[stop[long]] + 1, lo[stop[long]], hi[stop[long]]))
                # at an unknown word nothing goes on; at the beginning of the stretch nothing is left
                e[stop] = np.where(word < 0, s[stop] - 1, np.where(word == 0, begin[stop] - 1, np.minimum(e[stop] - 1, s[stop] + k - 1)))
                s[stop] = e[stop]
                lo[stop], hi[stop] = 0, self.n
                alive = alive[e[alive] - begin[alive] >= k - 1]
        return tuple(np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else ((),) * 5))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the interval of suffixes that begin with symbol and go on with those of [lo, hi)."""
        base = symbol.astype(np.int64) * (self.n + 1)
        order = np.argsort(base + lo, kind="stable")  # searches in order stay in the cache
        new_lo, new_hi = np.empty_like(lo), np.empty_like(hi)
        new_lo[order] = np.searchsorted(self.last, (base + lo)[order])
        new_hi[order] = np.searchsorted(self.last, (base + hi)[order])
        return new_lo, new_hi

    def search(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) of each row of `runs` (symbols of k words); equal rows are best given once."""
        k = runs.shape[1]
        first = np.asarray(self.first)
        c = runs[:, k - 1]
        bad = (runs < 1).any(1)
        c = np.where(bad, 1, c)
        lo, hi = first[c], first[c + 1]
        for j in range(k - 2, -1, -1):
            alive = np.flatnonzero((hi > lo) & ~bad)
            new_lo, new_hi = self.extend(runs[alive, j], lo[alive], hi[alive])
            lo, hi = np.zeros_like(lo), np.zeros_like(hi)
            lo[alive], hi[alive] = new_lo, new_hi
        hi[bad] = lo[bad] = 0
        return lo, hi

    def words_of(self, d: int) -> np.ndarray:
        """The words' numbers of text d, in order."""
        return np.asarray(self.vocab)[np.asarray(self.text[self.start[d] : self.start[d + 1] - 1]).astype(np.int64) - 1]


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Bit vectors in which each shingle flips one bit: those of two sets differ in at most as many bits as the sets in shingles."""
    out = np.empty((len(sets), SKETCH_BITS // 64), np.uint64)
    for i, s in enumerate(sets):
        bits = np.bincount((s >> np.uint64(20)) % np.uint64(SKETCH_BITS), minlength=SKETCH_BITS) & 1
        out[i] = np.packbits(bits.astype(np.uint8)).view("<u8")
    return out


def merged_words(tokens: np.ndarray, other: np.ndarray, k: int) -> int:
    """Words of a text within matches with a set of shingles: overlapping matches are merged to spans."""
    at = np.flatnonzero(np.isin(shingles_at(tokens, k), other))
    covered = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + k, -1)
    return int((np.cumsum(covered) > 0).sum())


def longest_match(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """Words of the longest run that two texts share; 0 if it is shorter than k."""
    places: dict[int, list[int]] = {}
    for j, h in enumerate(shingles_at(b, k).tolist()):
        places.setdefault(h, []).append(j)
    best, before = 0, {}
    for h in shingles_at(a, k).tolist():
        now = {j: before.get(j - 1, 0) + 1 for j in places.get(h, ())}
        best = max(best, max(now.values(), default=0))
        before = now
    return best + k - 1 if best else 0


def _build(path: str, k: int):
    """One shard: the texts of a group become an index of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, offsets = token_batch(pdf["text"], WordIds())
        sets = shingle_batch(tokens, offsets, k)
        sizes = np.array([len(s) for s in sets], np.int64)
        keep = sizes > 0  # a text without words has no tokens either: offsets stay right
        if not keep.any():
            return pd.DataFrame({"shard": [], "least": [], "most": [], "texts": [], "words": []})
        name = str(pdf["shard"].iloc[0])
        lens = np.diff(offsets)[keep]
        _write(path, name, WordIndex.build(tokens, np.concatenate([[0], np.cumsum(lens)]), pdf["key"].to_numpy()[keep], sizes[keep], sketch([s for s in sets if len(s)])))
        return pd.DataFrame({"shard": [name], "least": [int(sizes[keep].min())], "most": [int(sizes.max())], "texts": [int(keep.sum())], "words": [len(tokens)]})

    return run


#: Lengths of texts are told apart by this ratio when shards are cut; characters that a word takes on the average.
LENGTH_STEP, WORD_CHARS = 1.05, 6


def cut_shards(texts: DataFrame) -> tuple[DataFrame, int]:
    """texts(key, text) with `shard`, and the number of shards: consecutive lengths together, about SHARD_WORDS words in each.

    The cut is made on sums by length class, of which there are some hundreds whatever the texts; a class that fills several shards is
    spread over them by a hash of the key.
    """
    spark = texts.sparkSession
    step = F.floor(F.ln(F.length("text") + 1) / F.lit(float(np.log(LENGTH_STEP)))).cast("int").alias("step")
    room = SHARD_WORDS * WORD_CHARS
    rows, shard, used = [], 0, 0
    for r in texts.groupBy(step).agg(F.sum(F.length("text")).alias("n")).orderBy("step").collect():
        parts = -(-r["n"] // room) if r["n"] else 1
        if used and used + r["n"] > room:
            shard, used = shard + 1, 0
        rows.append((r["step"], shard, parts))
        shard, used = (shard + parts, 0) if parts > 1 else (shard, used + r["n"])
    n = shard + (1 if used or not rows else 0)
    plan = spark.createDataFrame(rows, "step int, base int, parts int")
    spot = F.col("base") + F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    return texts.withColumn("step", step).join(F.broadcast(plan), "step").select("key", "text", spot.alias("shard")), n  # a row for each class


def _compare(path: str, k: int, similarity: float):
    """Rows (shard, train_key, text, eval_keys), shards together: a training text beside the candidates that it has among a shard's texts."""

    def matches(ix: WordIndex, symbols, offsets, docs) -> tuple[np.ndarray, ...]:
        """(text, begin, end, lo, hi): the maximal matches of the texts `docs`, in stretches of STRETCH words; runs over a cut belong to the later stretch."""
        pieces = np.maximum(1, -(-(offsets[docs + 1] - offsets[docs]) // STRETCH))
        text = np.repeat(docs, pieces)
        no = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        end = np.minimum(offsets[text] + (no + 1) * STRETCH, offsets[text + 1])
        begin = np.maximum(offsets[text], offsets[text] + no * STRETCH - (k - 1))
        which, b, e, lo, hi = ix.maximal(symbols, begin, end, k)
        return text[which], b, e, lo, hi

    def similar(ix: WordIndex, sets_of: dict, texts: pd.Series, ids: WordIds, a: np.ndarray, b: np.ndarray) -> list[tuple[int, ...]]:
        """(training text, indexed text, shared shingles, union, longest match, matched words) of the similar ones among the pairs (a, b)."""
        tokens, offsets = token_batch(texts, ids)
        sets = shingle_batch(tokens, offsets, k)
        n, width = np.array([len(s) for s in sets]), np.diff(offsets)
        out = []
        short = width[a] < k  # texts shorter than a shingle are similar to equal ones only
        for d, y in zip(a[short].tolist(), b[short].tolist(), strict=True):
            if np.array_equal(ix.words_of(y), tokens[offsets[d] : offsets[d + 1]]):
                out.append((d, y, 1, 1, int(width[d]), int(width[d])))
        a, b = a[~short], b[~short]
        theirs, mine = np.asarray(ix.sketch), sketch(sets)
        far = np.concatenate([np.empty(0, np.int64), *(np.bitwise_count(mine[a[i : i + 65536]] ^ theirs[b[i : i + 65536]]).sum(1, dtype=np.int64) for i in range(0, len(a), 65536))])
        near = far <= np.floor((1 - similarity) / (1 + similarity) * (n[a] + np.asarray(ix.size)[b]) + 1e-9)
        a, b = a[near], b[near]
        if not len(a):
            return out
        # maximal matches of the texts that are left; overlapping ones merge to spans, and a text whose spans hold too few of its shingles is no match of anything
        words, spelt = np.unique(tokens, return_inverse=True)
        text, begin, end, lo, hi = matches(ix, ix.symbols(words)[spelt], offsets, distinct(a))
        edge = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
        span = covered[offsets[a + 1]] - covered[offsets[a]]
        enough = span >= least_overlap(n[a], np.asarray(ix.size)[b], similarity)
        for d, y in zip(a[enough].tolist(), b[enough].tolist(), strict=True):
            other = sets_of.get(y)
            if other is None:
                w = ix.words_of(y)
                other = sets_of[y] = shingle_batch(w, np.array([0, len(w)]), k)[0]
            both = len(np.intersect1d(sets[d], other, assume_unique=True))
            if both >= least_overlap(n[d], len(other), similarity):
                mine = tokens[offsets[d] : offsets[d + 1]]
                out.append((d, y, both, int(n[d]) + len(other) - both, longest_match(mine, ix.words_of(y), k), merged_words(mine, other, k)))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        name, ix, sets_of, order = None, None, {}, None
        for pdf in batches:
            rows = []
            for shard, part in pdf.groupby("shard"):
                if shard != name:
                    name, ix, sets_of = shard, WordIndex(lambda x, shard=shard: _read(path, str(shard), x)), {}
                    order = np.argsort(ix.key)
                if len(sets_of) > 100_000:
                    sets_of.clear()
                keys = part["train_key"].to_numpy()
                a = np.repeat(np.arange(len(part)), part["eval_keys"].map(len))
                b = order[np.searchsorted(ix.key, np.concatenate(part["eval_keys"].to_list()), sorter=order)]
                rows += [(keys[d], int(ix.key[y]), *rest) for d, y, *rest in similar(ix, sets_of, part["text"], ids, a, b)]
            yield pd.DataFrame(rows, columns=["train_key", "eval_key", "shared", "total", "longest", "matched"])

    return run


def split_overlap(df: DataFrame, row: str = "rec_no", text: str = "text", split: str = "split", train: str = "train", evals: tuple[str, ...] = ("dev", "test"), similarity: float = 0.8, words: int = 5) -> DataFrame:
    """(train_row, eval_row, eval_split, shared, total, longest, matched) for each training row and evaluation row of similar texts.

    similarity = shared / total in shingles; longest and matched: words of the longest match, and within all matches, merged to spans.

    Similar: Jaccard similarity of the sets of `words`-word shingles at least `similarity` (a text of fewer words is one
    shingle). Distinct texts of both sides meet at their rarest shingles, by range of the shingle, and only with the other side
    (close_sets), so work does not grow with the product of the sides. Evaluation texts that have a candidate, in order of length, become shards of a
    word-level FM-index, about SHARD_WORDS words each however long the texts, in the shared folder; a training text goes to the
    shards of its candidates alone. There backward search goes on word by word to the maximal matches, which merge to spans;
    pairs whose spans could hold enough shingles are compared in full. Nothing is capped. Copies are
    searched once and joined back at the end. Null texts, texts without words and other splits take no part; empty sides give no rows.
    """
    spark = df.sparkSession
    src = df.where(F.col(text).isNotNull() & F.col(split).isin(train, *evals))
    src = src.select(F.col(row).cast("long").alias("row"), F.col(split).alias("split"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("second"), text).alias("g"))
    of_side = lambda trains: F.col("split") == train if trains else F.col("split") != train
    # a text is told by 128 bits and named by the least row that has it on its side
    texts = lambda trains: src.where(of_side(trains)).groupBy("h", "g").agg(F.min("row").alias("row"), F.first("text").alias("text")).select("row", "text")
    made = lambda trains: texts(trains).mapInPandas(sets_of_texts(words), SETS).withColumn("trains", F.lit(trains))
    marked = F.col("set").bitwiseAND(F.lit(~SIDE)).bitwiseOR(F.col("trains").cast("long") * SIDE)
    raw = stage(made(True).unionByName(made(False)).withColumn("set", marked), "overlap-sets")
    told = apart(raw)
    sets = told.withColumn("set", marked)  # where a number was changed its side was too
    met = close_sets(sets, similarity, across=True)
    first = F.col("a").bitwiseAND(F.lit(SIDE)) == SIDE
    met_by_side = met.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("train_set"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("eval_set"))
    keys = lambda trains, c: sets.where(F.col("trains") == trains).select(F.col("set").alias(f"{c}_set"), F.col("row").alias(f"{c}_key"))
    pairs = stage(met_by_side.join(keys(True, "train"), "train_set").join(keys(False, "eval"), "eval_set").select("train_key", "eval_key"), "overlap-candidates")
    unstage(raw, told, met)
    involved = lambda trains, c: src.where(of_side(trains)).select(F.col("row").alias(c), "text").join(pairs.select(c).distinct(), c, "left_semi")
    path = new_path(spark, "index")
    sized, parts = cut_shards(stage(involved(False, "eval_key").withColumnRenamed("eval_key", "key"), "overlap-texts"))
    sized.repartition(parts, "shard").groupBy("shard").applyInPandas(_build(path, words), "shard string, least long, most long, texts long, words long").collect()  # a row for each shard
    routed = pairs.join(sized.select(F.col("key").alias("eval_key"), "shard"), "eval_key").groupBy("shard", "train_key").agg(F.collect_list("eval_key").alias("eval_keys"))  # of one shard
    routed = routed.join(involved(True, "train_key"), "train_key").select("shard", "train_key", "text", "eval_keys")
    routed = routed.repartition("shard", F.pmod(F.xxhash64("train_key"), F.lit(SPREAD))).sortWithinPartitions("shard")
    found = stage(routed.mapInPandas(_compare(path, words, similarity), "train_key long, eval_key long, shared long, total long, longest long, matched long"), "overlaps")
    rows = src.select("row", "split", (F.col("split") == train).alias("trains"), "h", "g")
    named = stage(rows.join(rows.groupBy("trains", "h", "g").agg(F.min("row").alias("key")), ["trains", "h", "g"]).select("trains", "row", "split", "key"), "overlap-rows")
    left = named.where("trains").select(F.col("key").alias("train_key"), F.col("row").alias("train_row"))
    right = named.where("not trains").select(F.col("key").alias("eval_key"), F.col("row").alias("eval_row"), F.col("split").alias("eval_split"))
    return found.join(left, "train_key").join(right, "eval_key").select("train_row", "eval_row", "eval_split", "shared", "total", "longest", "matched")


def overlap_counts(overlaps: DataFrame, df: DataFrame, row: str = "rec_no", source: str = "model") -> DataFrame:
    """(eval_split, source, eval_rows, pairs): evaluation rows that stand in the training split too, and the pairs."""
    named = df.select(F.col(row).alias("eval_row"), F.col(source).alias("source"))
    return overlaps.join(named, "eval_row").groupBy("eval_split", "source").agg(F.countDistinct("eval_row").alias("eval_rows"), F.count("*").alias("pairs"))
