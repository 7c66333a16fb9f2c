"""Content-addressed store of token ids.

Encoding: each text is encoded with a vocabulary file of the tokenizers library (no special tokens added;
null texts count as empty), then an end id is appended. A rolling hash over the last ids cuts the stream of a
document into chunks, so equal passages give equal chunks wherever they stand. A chunk is stored once under the
digest of its bytes; a document is a recipe, the list of its chunks' digests, under a Merkle root. Recipes are
written in ascending doc_id order (null first), one manifest row for each recipe file with the Merkle root of
its recipes.

    <path>/chunks    digest binary, payload binary   ids as little-endian unsigned integers of `width` bytes
    <path>/recipes   doc_id, n_tokens, root, digests, part
    <path>/manifest  part, n_docs, n_tokens, root, width

Cases: an empty or null text is one chunk with the end id; equal texts share one root; repeated rows each have
a recipe; an empty table gives empty files; other columns are not read.

The different words of a slice of texts are encoded once: the vocabulary's pre-tokenizer drops white space and never
joins across it, so the ids of a text are those of its words in order (tests hold this against whole texts).
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colguard.llm.common import Scratch, Words, hot_keys, mix64, odd_constants, release, salted_join, slices

WINDOW, MASK, LEAST, MOST = 8, 0xFF, 64, 1024
SLICE_BYTES, SEEN = 10 << 20, 100_000
_CACHE: dict = {}


#: Words of these characters alone need no normalizing but lower case, and their pieces need no pattern but _PIECE:
#: printable ASCII without the apostrophe, and the Latin letters up to U+017F whose lower case is one character.
_PLAIN = "^[!-&(-~\u00c0-\u012f\u0131-\u017f]+$"
_PIECE = "([a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+)"


def _joined(size: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strings in a row have `size` ids each, all in `ids`: how many the strings at each place have, and theirs in a row."""
    first = (np.cumsum(size) - size)[place]
    n = size[place]
    done = np.concatenate([[0], np.cumsum(n)])
    return n, ids[np.repeat(first - done[:-1], n) + np.arange(done[-1])]


class Encoder:
    """Encodes batches of texts. Nothing is kept between batches, so a worker's memory is bounded by its slice of texts.

    Plain words are cut into the vocabulary's pieces (runs of letters, single digits, runs of the rest) here, all words
    of a batch at once, and the library's model encodes each different piece once; every other word goes through the whole
    tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's own threads only cost memory
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        blanks = pre_tokenizers.WhitespaceSplit()
        self.ascii, self.wide = Tokenizer(self.tok.model), Tokenizer(self.tok.model)
        self.ascii.pre_tokenizer = blanks
        self.wide.pre_tokenizer = pre_tokenizers.Sequence([blanks, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tok.get_vocab_size() + 1, bool)  # ids that end a piece
        self.last[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _CACHE:
            _CACHE[path] = cls(path)
        return _CACHE[path]

    def _pieces(self, texts: pa.Array, tok) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all of them in a row."""
        found, ends = [np.zeros(0, np.uint32)], np.minimum(np.arange(0, len(texts) + 512, 512), len(texts))
        for at in range(0, len(ends) - 1, 32):
            runs = pa.LargeListArray.from_arrays(pa.array(ends[at : at + 33]), texts.cast(pa.large_string()))
            joined = pc.binary_join(runs, pa.scalar(" ", pa.large_string())).to_pylist()
            found += [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(found)
        size = np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0)
        if len(size) != len(texts) or size.sum() != len(ids):
            raise ValueError("the vocabulary does not end each piece with an id of its own kind")
        return size, ids

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them in a row."""
        words = words.cast(pa.large_string())
        plain = np.asarray(pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|"))))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        easy, other = words.filter(pa.array(plain)), words.filter(pa.array(~plain))
        sizes, found = [], []
        if len(easy):
            cuts = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(easy), _PIECE, r"\1 "), " ")  # "" after the last piece
            count = np.asarray(pc.list_value_length(cuts)).astype(np.int64) - 1
            flat = cuts.flatten()
            coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
            uniq = coded.dictionary
            short = pc.string_is_ascii(uniq)
            some, rest = self._pieces(uniq.filter(short), self.ascii), self._pieces(uniq.filter(pc.invert(short)), self.wide)
            at = np.empty(len(uniq), np.int64)
            at[np.concatenate([np.flatnonzero(np.asarray(short)), np.flatnonzero(~np.asarray(short))])] = np.arange(len(uniq))
            n, ids = _joined(np.concatenate([some[0], rest[0]]), np.concatenate([some[1], rest[1]]), at[np.asarray(coded.indices)])
            sizes.append(np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])]))
            found.append(ids)
        for at in range(0, len(other), 1 << 12):
            mine = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(other.slice(at, 1 << 12).to_pylist(), add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, mine), np.int64, len(mine)))
            found += mine
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return _joined(np.concatenate([*sizes, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.uint32)]), place)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by `end`, and the offsets of the texts."""
        # special tokens are told by case, so a text that may hold one is not lower-cased ahead
        words = Words(texts, lower=not pc.any(pc.match_substring(texts, "<|")).as_py())
        size, flat = self._words(words.uniq)
        first = np.cumsum(size) - size
        n = size[words.ids]
        done = np.concatenate([[0], np.cumsum(n)])
        starts = done[words.start] + np.arange(len(words.start))
        src = np.repeat(first[words.ids] - done[:-1], n) + np.arange(done[-1])
        out = np.full(int(done[-1]) + len(words.start) - 1, end, np.uint32)
        inside = np.ones(len(out), bool)
        inside[starts[1:] - 1] = False
        out[inside] = flat[src]
        return out, starts


def cut(ids: np.ndarray, start: np.ndarray) -> list[list[int]]:
    """For each text the ends of its chunks: where the hash of the last WINDOW ids has its low bits set, at
    least LEAST and at most MOST ids apart."""
    mul = odd_constants(WINDOW, 7)
    g = mix64(ids)
    h = np.zeros(len(ids), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(WINDOW, len(ids))):
            h[j:] += g[: len(g) - j] * mul[j]
    marks = np.flatnonzero((h >> np.uint64(24)) & np.uint64(MASK) == MASK) + 1
    lo, hi = np.searchsorted(marks, start[:-1]), np.searchsorted(marks, start[1:], side="right")
    out = []
    for r, (s, e) in enumerate(zip(start[:-1].tolist(), start[1:].tolist(), strict=True)):
        ends, at = [], s
        for m in marks[lo[r] : hi[r]].tolist():
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST and m < e:
                at = m
                ends.append(m)
        while e - at > MOST:
            at += MOST
            ends.append(at)
        ends.append(e)
        out.append(ends)
    return out


def merkle(digests: list[bytes]) -> bytes:
    """Root of the binary tree over digests; a node left over goes up unchanged."""
    level = digests or [b""]
    while len(level) > 1:
        up = [hashlib.blake2b(b"\x01" + a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = up + level[-1:] * (len(level) % 2)
    return hashlib.blake2b(b"\x02" + level[0], digest_size=16).digest()


def _digest(payload: bytes) -> bytes:
    return hashlib.blake2b(b"\x00" + payload, digest_size=16).digest()


_STAGED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("digests", pa.list_(pa.binary())), ("payloads", pa.list_(pa.binary()))])


def _stage(vocab: str, end: int, width: int):
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = Encoder.of(vocab), set()
        for whole in batches:
            for b in slices(whole, "text", SLICE_BYTES):
                ids, start = enc.encode(b.column("text"), end)
                raw = ids.astype(kind).tobytes()
                roots, lists, data = [], [], []
                for s, ends in zip(start[:-1].tolist(), cut(ids, start), strict=True):
                    mine, own = [], []
                    for e in ends:
                        payload = raw[s * width : e * width]
                        d = _digest(payload)
                        mine.append(d)
                        own.append(None if d in seen else payload)
                        seen.add(d)
                        s = e
                    roots.append(merkle(mine))
                    lists.append(mine)
                    data.append(own)
                if len(seen) > SEEN:
                    seen.clear()  # only saves bytes; the store itself drops what comes twice
                yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(start)), pa.array(roots, pa.binary()), pa.array(lists, pa.list_(pa.binary())), pa.array(data, pa.list_(pa.binary()))], schema=_STAGED)
                release()

    return run


def write_store(docs: DataFrame, path: str, vocab: str, end: int = 2, width: int = 2) -> None:
    """Encodes docs (doc_id, text) into a store at `path`. width: bytes of an id; 2 holds vocabularies up to 65,536 ids."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    staged = scratch.put(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(_stage(vocab, end, width), "doc_id long, n_tokens long, root binary, digests array<binary>, payloads array<binary>"), "staged")
    pairs = staged.select(F.explode(F.filter(F.arrays_zip("digests", "payloads"), lambda x: x["payloads"].isNotNull())).alias("c"))
    chunks = pairs.select("c.digests", "c.payloads").groupBy(F.col("digests").alias("digest")).agg(F.first("payloads").alias("payload"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = staged.select("doc_id", "n_tokens", "root", "digests").repartitionByRange(F.col("doc_id").asc_nulls_first())
    recipes.sortWithinPartitions(F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/recipes")
    scratch.drop(staged)
    by_doc = F.array_sort(F.collect_list(F.struct("doc_id", "root")))
    # a part is one file's recipes, 24 bytes each here
    manifest = read_recipes(spark, path).groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.transform(by_doc, lambda x: x["root"]).alias("roots"))
    out = pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("width", pa.int32())])

    def rooted(batches):
        for b in batches:
            yield pa.record_batch([b.column("part"), b.column("n_docs"), b.column("n_tokens"), pa.array([merkle(x) for x in b.column("roots").to_pylist()], pa.binary()), pa.array([width] * len(b), pa.int32())], schema=out)

    # made in many tasks; only then one row for each recipe file comes together in one
    made = scratch.put(manifest.mapInArrow(rooted, "part int, n_docs long, n_tokens long, root binary, width int"), "manifest")
    made.coalesce(1).write.parquet(f"{path}/manifest")
    scratch.drop(made)


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, root binary, digests array<binary>, part int").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, payload binary").parquet(f"{path}/chunks")


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id and ids (array of int): every document put together from its recipe."""
    recipes = read_recipes(spark, path)
    each = recipes.groupBy("root").agg(F.first("digests").alias("digests"), F.count("*").alias("copies"))  # equal texts are put together once
    refs = each.select("root", F.posexplode("digests").alias("pos", "digest"))
    total = each.select(F.sum(F.size("digests"))).head()[0] or 0
    often = hot_keys(refs.groupBy("digest").agg(F.count("*").alias("c")), "digest", "c", total)
    parts = salted_join(refs, read_chunks(spark, path), "digest", often, ["root"]).groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "payload"))), lambda x: x["payload"]).alias("parts"))
    held = salted_join(recipes.select("doc_id", "root"), parts, "root", hot_keys(each, "root", "copies", recipes.count()), ["doc_id"])
    kind = {2: "<u2", 4: "<u4"}[width]

    def join(batches):
        for b in batches:
            ids = [np.frombuffer(b"".join(p), kind).astype(np.int32) for p in b.column("parts").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return held.select("doc_id", "parts").mapInArrow(join, "doc_id long, ids array<int>")


# CRC-32 of a whole from those of its parts: the CRC register is linear, so a part's CRC is carried over the
# bytes behind it by multiplying with a power of x modulo the polynomial.
_POLY = 0xEDB88320


def _carry_tables() -> np.ndarray:
    """[k][byte place][byte]: the register after 2**k zero bytes."""
    one = np.array([1 << i for i in range(32)], np.uint64)
    for _ in range(8):
        one = np.where(one & np.uint64(1), (one >> np.uint64(1)) ^ np.uint64(_POLY), one >> np.uint64(1))
    tables = []
    for _ in range(48):
        place = np.zeros((4, 256), np.uint32)
        for p in range(4):
            for bit in range(8):
                place[p, np.arange(256) >> bit & 1 == 1] ^= np.uint32(one[8 * p + bit])
        tables.append(place)
        one = _apply(place, one.astype(np.uint32)).astype(np.uint64)
    return np.stack(tables)


def _apply(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    return t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]


def join_crcs(crcs: np.ndarray, behind: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Each part's share in the whole's CRC-32: `behind` bytes follow it. The whole is the XOR of the shares."""
    out = crcs.astype(np.uint32)
    for k in range(int(behind.max(initial=0)).bit_length()):
        on = (behind >> k & 1).astype(bool)
        out[on] = _apply(tables[k], out[on])
    return out


def verified_documents(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) from the files alone.

    Each stored chunk is read once; its digest is made anew and must be the one it is stored under. Chunks' CRCs
    are then put together along the recipes; Merkle roots and counts of ids must agree, or the job fails.
    """
    first = spark.read.parquet(f"{path}/manifest").select("width").head()
    kind = {2: "<u2", 4: "<u4"}[first[0] if first else 2]

    def digests(batches):
        for b in batches:
            ok, crc, n = [], [], []
            for d, p in zip(b.column("digest").to_pylist(), b.column("payload").to_pylist(), strict=True):
                if _digest(p) != d:
                    raise ValueError(f"chunk {d.hex()} does not match its digest")
                ids = np.frombuffer(p, kind)
                ok.append(d)
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                n.append(len(ids))
            yield pa.record_batch([pa.array(ok, pa.binary()), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], names=["digest", "crc", "n"])

    def whole(batches):
        tables = _carry_tables()
        for b in batches:
            size = np.asarray(pc.list_value_length(b.column("parts")), np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            flat = b.column("parts").flatten()
            crc, n = np.asarray(flat.field("crc")).astype(np.uint32), np.asarray(flat.field("n")).astype(np.int64)
            total = np.add.reduceat(n, at[:-1])
            behind = np.repeat(total, size) - (np.cumsum(n) - np.repeat(np.cumsum(total) - total, size))
            out = np.bitwise_xor.reduceat(join_crcs(crc, 4 * behind, tables), at[:-1])
            made = flat.field("digest").to_pylist()
            for root, x, y in zip(b.column("root").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if merkle(made[x:y]) != root:
                    raise ValueError(f"recipe {root.hex()} does not match its chunks")
            yield pa.record_batch([b.column("root"), pa.array(out.astype(np.int64)), pa.array(total)], names=["root", "crc", "n"])

    recipes = read_recipes(spark, path)
    stored = read_chunks(spark, path).mapInArrow(digests, "digest binary, crc long, n long")
    each = scratch.put(recipes.groupBy("root").agg(F.first("digests").alias("digests"), F.count("*").alias("copies")), "each")
    refs = each.select("root", F.posexplode("digests").alias("pos", "digest"))
    often = hot_keys(refs.groupBy("digest").agg(F.count("*").alias("c")), "digest", "c", each.select(F.sum(F.size("digests"))).head()[0] or 0)
    parts = salted_join(refs, stored, "digest", scratch.put(often, "often"), ["root"], "left").groupBy("root").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", F.expr("coalesce(crc, raise_error('a chunk is missing')) AS crc"), "n"))).alias("parts"))
    roots = scratch.put(parts.mapInArrow(whole, "root binary, crc long, n long"), "roots")
    rows = recipes.select("doc_id", "n_tokens", "root", "part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))  # a row for each recipe file
    out = salted_join(placed, roots, "root", scratch.put(hot_keys(each, "root", "copies", recipes.count()), "copies"), ["doc_id", "start"])
    n = F.when(F.col("n") == F.col("n_tokens"), F.col("n")).otherwise(F.raise_error(F.lit("a recipe has another number of ids than its chunks")).cast("long"))
    return out.select("doc_id", "start", n.alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "op10")
    path = scratch.path("store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return verified_documents(spark, path, scratch)
