"""N-gram Jaccard join by a MinHash LSH forest, exact in its verification.

Forest: TREES trees; a document's label in a tree is DEPTH MinHash values of its word shingles. Labels are sorted, so
a tree is a trie of prefixes. Matching starts with whole labels and shortens the prefix until the chance that a pair
of the least similarity shares one in some tree reaches TARGET; `matched_depth` works that depth out. In each prefix
group, members are taken in sorted order, so that the longest shared prefixes meet first, and each meets all that are
not joined with it yet; a pair counts if a sketch of SKETCH four-bit values (carried along) doesn't rule it out.
That gives loose groups, by union-find. Inside a loose group every pair is then compared exactly, in blocks of bounded
size, so neither pairs nor groups are ever laid out as rows: a block gives each member its number of links.

Documents with equal shingle sets are one class and are compared once. Documents of fewer words than a shingle have
one shingle, all their words; those without words link to nothing. Nulls count as empty texts. Ids may repeat: each
row is a document. Columns beside id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import bitmap, deal, in_pairs, inside, unique_pairs
from .bpe import Memo
from .common import Stash, held, width
from .components import components
from .minhash import band_keys, signatures, windows
from .tokens import slices

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, TARGET, SKETCH = 24, 8, 0.9999, 64
#: A sketch rules a pair out whose share of equal values is so many standard deviations below that of a pair of the least
#: similarity.
DEVIATIONS = 5.25
#: Distinct documents of a block, and its shingles, about; documents of small groups that a task takes; shingles that
#: are laid out at once; members of a group that is compared pair by pair.
BLOCK, BLOCK_SHINGLES, TASK_DOCS, RUN, FEW = 800, 2_000_000, 1500, 500_000, 5
TASK_ENTRIES = 500_000
#: Words whose hashes a worker remembers.
MEMO_HASHES = 500_000
#: Characters that are shingled at once; sized for a processor's cache.
SLICE_CHARS = 250_000
ENTRY = np.dtype([("key", "<u4"), ("rest", "V3"), ("id", "<i8"), ("sketch", "V32")])


def matched_depth(similarity: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix that finds a pair of this similarity with the target chance; an error if none does."""
    for d in range(depth, 0, -1):
        if 1 - (1 - similarity**d) ** trees >= target:
            return d
    raise ValueError(f"{trees} trees don't find pairs of similarity {similarity} with chance {target}")


def least_sketch(similarity: float) -> float:
    """The least share of equal four-bit sketch values that is still looked at: values of a pair are equal with chance
    s + (1 - s) / 16."""
    p = similarity + (1 - similarity) / 16
    return p - DEVIATIONS * math.sqrt(p * (1 - p) / SKETCH)


def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def words_of(text: str | None) -> list[str]:
    """Runs without ASCII white space."""
    t = text or ""
    return t.split() if t.isascii() and not any(c in t for c in "\x1c\x1d\x1e\x1f") else t.translate(_BLANKS).split(" ") if t else []


_BLANKS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def doc_shingles(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Per text: the sorted distinct hashes of its word shingles."""
    memo = held("shingles")
    if not memo:
        memo["hash"] = Memo(_word_hash, MEMO_HASHES)
    get = memo["hash"].__getitem__
    lists = [[get(w) for w in words_of(t) if w] for t in texts]
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((h for x in lists for h in x), np.uint64, int(lens.sum()))
    hashes, counts = windows(flat, lens, k)
    cuts = np.cumsum(counts)[:-1]
    return [np.unique(x) for x in np.split(hashes, cuts)]


def set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _nibbles(sig: np.ndarray) -> np.ndarray:
    low = (sig[:, :SKETCH] & np.uint32(15)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def _share(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Share of equal four-bit values between a sketch and others."""
    x = many ^ one
    return (((x & 15) == 0).sum(axis=1) + ((x >> 4) == 0).sum(axis=1)) / SKETCH


def alike(sketch: np.ndarray, least: float) -> np.ndarray:
    """Per row: the first row that it is joined with, directly or not. Each row meets all those not yet joined; a pair
    is joined if `least` of its values are equal."""
    root = np.arange(len(sketch))
    left, rest = root[1:], sketch[1:]
    first, todo = 0, [0]
    while len(left):
        if not todo:
            first, left, rest = int(left[0]), left[1:], rest[1:]
            todo = [first]
            continue
        near = _share(sketch[todo.pop()], rest) >= least
        if near.any():
            root[left[near]] = first
            todo += left[near].tolist()
            left, rest = left[~near], rest[~near]
    return root


def describe(docs: DataFrame, id_col: str, text_col: str, parts: int, words: int, depth: int) -> DataFrame:
    """Rows of two kinds: (id, cls, h, th) for each document (its class, that one's short id, its text's hash), and
    (part, blob) of forest entries."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("cls", T.BinaryType()), T.StructField("h", T.LongType()), T.StructField("th", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("blob", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for r in slices(texts, SLICE_CHARS):
                sets = doc_shingles([texts[i] for i in r], words)
                cls = [set_id(s) if len(s) else None for s in sets]
                n = len(r)
                short = pa.array([int.from_bytes(c[:8], "little", signed=True) if c else None for c in cls], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r.start, n), pa.array(cls, pa.binary()), short, batch.column(2).slice(r.start, n), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=schema.names)
                own = list({c: i for i, c in enumerate(cls) if c}.values())  # a copy of each set
                if not own:
                    continue
                counts = np.fromiter((len(sets[i]) for i in own), np.int64, len(own))
                sig = signatures(np.concatenate([sets[i] for i in own]), counts, TREES * DEPTH)
                labels = sig.reshape(len(own), TREES, DEPTH)
                keys = np.concatenate([band_keys(labels[:, t, :depth], depth) + np.uint64(t) for t in range(TREES)], axis=1)
                e = np.empty((len(own), TREES), dtype=ENTRY)
                e["key"] = keys.astype(np.uint32)
                tail = np.zeros((len(own), TREES, 3), dtype=np.uint8)
                more = min(3, DEPTH - depth)
                tail[:, :, :more] = labels[:, :, depth : depth + more] & 255
                e["rest"] = tail.view("V3")[..., 0]
                e["id"] = np.frombuffer(b"".join(cls[i][:8] for i in own), "<i8")[:, None]
                e["sketch"] = np.ascontiguousarray(_nibbles(sig)).view("V32")
                got = list(zip(*deal(keys.ravel(), e.ravel(), parts), strict=True))
                m = len(got[0])
                yield pa.RecordBatch.from_arrays([pa.nulls(m, batch.schema.field(0).type), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(got[0], pa.int32()), pa.array(got[1], pa.binary())], names=schema.names)

    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, schema)


def loose_links(blobs: DataFrame, similarity: float) -> DataFrame:
    """(a, b): short class ids that a prefix group joins."""
    least = least_sketch(similarity)

    def meet(table: pa.Table) -> pa.Table:
        e = in_pairs(table, ENTRY)
        if not len(e):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        rest = np.frombuffer(e["rest"].tobytes(), np.uint8).reshape(-1, 3)
        e = e[np.lexsort((e["id"], rest[:, 2], rest[:, 1], rest[:, 0], e["key"]))]  # tries, in sorted order
        new = np.concatenate([[True], (e["key"][1:] != e["key"][:-1]) | (e["id"][1:] != e["id"][:-1])])
        e = e[new]
        sketch = np.frombuffer(e["sketch"].tobytes(), np.uint8).reshape(-1, 32)
        first = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]]))
        pairs = []
        for lo, hi in zip(first.tolist(), np.append(first[1:], len(e)).tolist(), strict=True):
            roots = alike(sketch[lo:hi], least)
            hit = np.flatnonzero(roots != np.arange(hi - lo))
            if len(hit):
                ids = e["id"][lo:hi]
                pairs.append(np.stack([ids[roots[hit]], ids[hit]]))
        both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        a, b = unique_pairs(both[0], both[1])
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return blobs.groupBy("part").applyInArrow(meet, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of sets[:split] with sets[split:] (split 0: of all with all), a bounded part at a time."""

    def runs(first: int, end: int) -> list[range]:
        out, size = [], 0
        for i in range(first, end):
            if not out or size + len(sets[i]) > RUN:
                out.append(range(i, i))
                size = 0
            out[-1], size = range(out[-1].start, i + 1), size + len(sets[i])
        return out

    n = len(sets)
    out = np.zeros((n, n) if not split else (split, n - split), dtype=np.float32)
    for a in runs(0, split or n):
        for b in runs(split, n):
            if split or a.start < b.start:
                got = _common(sets[a.start : a.stop] + sets[b.start : b.stop], len(a))
                out[a.start : a.stop, b.start - split : b.stop - split] = got
                if not split:
                    out[b.start : b.stop, a.start : a.stop] = got.T
            elif a.start == b.start:
                out[a.start : a.stop, a.start : a.stop] = _common(sets[a.start : a.stop], 0)
    return out


def _common(sets: list[np.ndarray], split: int) -> np.ndarray:
    lens = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], np.repeat(np.arange(len(sets), dtype=np.int32), lens)[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    first = np.flatnonzero(new)
    often = np.diff(np.append(first, len(flat))) > 1  # values that more than one set has
    keep = np.repeat(often, np.diff(np.append(first, len(flat))))
    row, col = row[keep], (np.cumsum(new[keep]) - 1).astype(np.int32)
    a, b = (len(sets), len(sets)) if not split else (split, len(sets) - split)
    out = np.zeros((a, b), dtype=np.float32)
    step = 4096
    for lo in range(0, int(often.sum()), step):
        i, j = np.searchsorted(col, [lo, lo + step])
        m = np.zeros((len(sets), step), dtype=np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        out += m @ m.T if not split else m[:split] @ m[split:].T
    return out


def many_links(sets: list[np.ndarray], split: int, similarity: float) -> np.ndarray:
    """The adjacency matrix of all sets, or only between sets[:split] and sets[split:]."""
    n = np.array([len(s) for s in sets], dtype=np.float64)
    both = overlaps(sets, split).astype(np.float64)
    a, b = (slice(None), slice(None)) if not split else (slice(0, split), slice(split, None))
    hit = both >= similarity * (n[a][:, None] + n[b][None, :] - both) - 1e-9
    if not split:
        np.fill_diagonal(hit, False)
        return hit
    out = np.zeros((len(sets), len(sets)), dtype=bool)
    out[:split, split:], out[split:, :split] = hit, hit.T
    return out


def forest(hit: np.ndarray) -> np.ndarray:
    """Per vertex of a symmetric adjacency matrix: the first vertex of its component. Each row is read once."""
    root = np.full(len(hit), -1, dtype=np.int64)
    for v in range(len(hit)):
        front = np.array([v]) if root[v] < 0 else np.zeros(0, np.int64)
        while len(front):
            root[front] = v
            front = np.flatnonzero(hit[front].any(axis=0) & (root < 0))
    return root


def few_links(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The adjacency matrix of a handful of sets, pair by pair; those of too different size aren't looked at."""
    hit = np.zeros((len(sets), len(sets)), dtype=bool)
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
                continue
            c = np.concatenate([a, b])
            c.sort(kind="stable")  # two sorted runs
            both = int(np.count_nonzero(c[1:] == c[:-1]))
            hit[i, j] = hit[j, i] = both >= similarity * (len(c) - both) - 1e-9
    return hit


def _frombytes(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype="<u8") for b in blobs]


def in_blocks(members: DataFrame, shingle_bytes: int, task_rows: int) -> DataFrame:
    """members: root, cls, copies, shingles. A row for each pair of blocks (i, j) that a member's group compares it in.

    shingle_bytes: of the column shingles for each shingle. A block has about BLOCK members and BLOCK_SHINGLES shingles
    at most; small groups are dealt to tasks of about task_rows rows and as many shingles as two blocks have.
    """
    size = F.sum(F.length("shingles").cast("long"))
    sizes = members.groupBy("root").agg(F.count("*").alias("m"), size.alias("bytes"))
    total = members.agg(F.count("*").alias("n"), size.alias("bytes")).first()
    n_tasks = max(width(members.sparkSession), -(-total["n"] // task_rows), -(-(total["bytes"] or 0) // (2 * BLOCK_SHINGLES * shingle_bytes)))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / (BLOCK_SHINGLES * shingle_bytes)), F.lit(1)).cast("int")
    dealt = members.join(sizes, "root").where("m > 1").withColumn("blocks", blocks)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(n_tasks))).otherwise(F.xxhash64("root").bitwiseOR(F.lit(1 << 62)))
    return dealt.withColumn("task", task).withColumn("p", F.explode(pairs)).select("task", "root", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", "cls", "copies", "shingles")


def exact_links(members: DataFrame, similarity: float, sets_of: Callable[[list[bytes]], list[np.ndarray]] = _frombytes) -> DataFrame:
    """members: task, root, i, j, block, cls, copies, shingles (which sets_of reads). Returns cls, links (documents), to: one cls of all that
    are linked with it inside the task, directly or not, so that the edges (cls, to) span every component of links."""

    def compare(key, table):
        root, block, cls, copies, blobs = (table.column(c).to_pylist() for c in ("root", "block", "cls", "copies", "shingles"))
        cross = key[1].as_py() != key[2].as_py()
        groups: dict[bytes, list[int]] = {}
        for r, x in enumerate(root):
            groups.setdefault(x, []).append(r)
        out: list[tuple[bytes, int, bytes]] = []
        all_sets = sets_of(blobs)
        for rows in groups.values():
            if cross:
                rows.sort(key=lambda r: block[r])
                split = sum(1 for r in rows if block[r] == block[rows[0]])
                if split == len(rows):
                    continue
            else:
                split = 0
            sets = [all_sets[r] for r in rows]
            if not cross and len(rows) <= FEW:
                hit = few_links(sets, similarity)
            else:
                hit = many_links(sets, split, similarity)
            if not hit.any():
                continue
            links, to = hit @ np.array([copies[r] for r in rows]), forest(hit)
            for k in np.flatnonzero(hit.any(axis=1)).tolist():
                out.append((cls[rows[k]], int(links[k]), cls[rows[to[k]]]))
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"cls": pa.array(cols[0], pa.binary()), "links": pa.array(cols[1], pa.int64()), "to": pa.array(cols[2], pa.binary())})

    return members.groupBy("task", "i", "j").applyInArrow(compare, "cls binary, links long, to binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, stash: Stash | None = None) -> DataFrame:
    """id, class_id, links: a row per document. class_id: the least id of those it is linked with, directly or not;
    links: how many other documents are at least that similar (exact copies count)."""
    spark = docs.sparkSession
    stash = stash or Stash(spark, "forest")
    depth = matched_depth(similarity, TREES, DEPTH, TARGET)
    parts = max(4 * width(spark), -(-docs.count() * TREES // TASK_ENTRIES))
    both = stash.put(describe(docs, id_col, text_col, parts, words, depth), "described")
    ids = both.where("part is null").select("id", "cls", "h", "th")
    loose = stash.put(loose_links(both.where("part is not null").select("part", "blob"), similarity), "loose")
    groups = components(loose, stash)
    # of each class in a group one text is read again; others with that hash do no harm, as classes are joined exactly
    wanted = ids.join(groups.select(F.col("v").alias("h")), "h", "left_semi").groupBy("cls").agg(F.min("th").alias("th"))
    bits = spark.sparkContext.broadcast(bitmap(wanted, "th"))
    classes = ids.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min("id").alias("least"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).filter(pa.array(inside(bits.value, batch.column(1).to_numpy()))).to_pylist()
            for r in slices(texts, SLICE_CHARS):
                found = {set_id(s): s for s in doc_shingles([texts[i] for i in r], words) if len(s)}
                if not found:
                    continue
                names = list(found)
                short = np.frombuffer(b"".join(c[:8] for c in names), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(short), pa.array(names, pa.binary()), pa.array([s.astype("<u8").tobytes() for s in found.values()], pa.binary())], names=["h", "cls", "shingles"])

    sets = docs.select(text_col, F.xxhash64(text_col)).mapInArrow(fetch, "h long, cls binary, shingles binary").groupBy("h", "cls").agg(F.first("shingles").alias("shingles"))
    sets = sets.join(groups.select(F.col("v").alias("h"), "root"), "h")
    members = stash.put(sets.join(classes.select("cls", "copies"), "cls").select("root", "cls", "copies", "shingles"), "members")
    linked = stash.put(exact_links(in_blocks(members, 8, TASK_DOCS), similarity), "links")
    groups2 = components(linked.select(F.col("cls").alias("a"), F.col("to").alias("b")), stash)
    counted = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.join(counted, "cls", "left").join(groups2.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("class_id"))
    known = known.join(least, "root").select("cls", "class_id", (F.col("links") + F.col("copies") - 1).alias("links"))
    out = ids.join(known, "cls", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return out
