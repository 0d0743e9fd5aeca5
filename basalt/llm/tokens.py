"""Encoding and decoding whole tables of documents with a tokenizer file, in bounded batches."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import CHAR_BYTES, MEMO_WORDS, Encoder, Memo, encoder, library
from .common import held

#: Characters of text that are encoded before rows leave, ids that the decoder takes at once, chunks a worker remembers.
BATCH_CHARS, DECODE_IDS = 2_000_000, 8192
MEMO_CHUNKS = 400_000
#: ASCII characters that are neither letters, numbers nor white space.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


class Chunks(dict):
    """Ids of chunks as uint32 bytes, remembered in two generations: when the young one is full, it becomes the old one.

    Letters, with ASCII marks after them at most, are the two matches that the word pattern would find, so they are
    encoded without it: most chunks that a corpus shows for the first time are such.
    """

    def __init__(self, enc: Encoder, word_ids: Callable[[str], list[int]], cap: int, remember: bool):
        """remember: keep words, too, since chunks share them; not worth it where encoding one costs little."""
        super().__init__()
        self.enc, self.cap, self.old = enc, cap, {}
        self.lower, self.lead = enc.kind == "words", int(enc.kind == "bytes")
        make = lambda w: array("I", word_ids(w)).tobytes()
        self.marks = Memo(make, MEMO_WORDS if remember else MEMO_WORDS // 8)
        self.word = self.marks.__getitem__ if remember else make

    def __missing__(self, c: str) -> bytes:
        value = self.old.get(c)
        if value is None:
            word = c.rstrip(MARKS)
            if (word[1:] if self.lead and word[:1] == " " else word).isalpha():
                low = (word.lower() if word.isascii() else self.enc.normalise(word)) if self.lower else word
                if low is word or not self.lower or low.isalpha():
                    value = self.word(low)
                    if len(word) < len(c):
                        value += self.marks[c[len(word) :]]
            if value is None:
                value = b"".join(map(self.marks.__getitem__, self.enc.pieces(c)))
        if len(self) >= self.cap:
            self.old = self.copy()
            self.clear()
        self[c] = value
        return value


class FastIds:
    """Ids of whole texts as uint32 bytes: chunks are looked up, only new ones are encoded."""

    def __init__(self, enc: Encoder, word_ids: Callable[[str], list[int]], remember: bool):
        self.enc = enc
        self.memo = Chunks(enc, word_ids, MEMO_CHUNKS, remember)
        self.special = {i: array("I", [i]).tobytes() for i in enc.special.values()}

    def __call__(self, text: str | None) -> bytes:
        get = self.memo.__getitem__
        return b"".join([b"".join(map(get, chunks)) if special is None else self.special[special] for special, chunks in self.enc.segments(text or "")])


def core_words(enc: Encoder) -> Callable[[str], list[int]]:
    """Ids of a word by the compiled merge loop of tiktoken, fed with the tokenizer file's own vocabulary.

    Its rule (the neighbours whose joint text has the lowest id merge first) gives the same ids as the ranked pairs
    where ids ascend with the merges. The end-of-word suffix becomes the byte 0xFF, which no UTF-8 text has.
    """
    import tiktoken

    ranks = {}
    for token, i in enc.table.vocab.items():
        body, end = (token[: -len(enc.suffix)], b"\xff") if enc.suffix and token.endswith(enc.suffix) and token != enc.suffix else (token, b"")
        if all(c in CHAR_BYTES for c in body):
            ranks[bytes(CHAR_BYTES[c] for c in body) + end] = i
    if [enc.table.vocab[a + b] for a, b in enc.table.rank] != sorted(enc.table.vocab[a + b] for a, b in enc.table.rank):
        raise ValueError("ids don't ascend with the merges: use the library")
    core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    end = b"\xff" if enc.suffix else b""
    return lambda w: core.encode_single_piece(w.encode("utf-8", "surrogatepass") + end)


def fast_ids(path: str, by: str = "transducer") -> FastIds:
    """by: what encodes new words: 'transducer' (this package's own), 'library' (tokenizers), 'core' (tiktoken's loop)."""
    fast = held("tokens")
    if (path, by) not in fast:
        enc = encoder(path)
        if by == "library":
            lib = library(path)
            make = lambda w: lib.encode(w, add_special_tokens=False).ids
        else:
            make = core_words(enc) if by == "core" else enc.word_ids
        fast[path, by] = FastIds(enc, make, by != "core")
    return fast[path, by]


def slices(texts: list[str | None], chars: int = BATCH_CHARS) -> Iterator[range]:
    """Row ranges of about so many characters; a longer text is one by itself."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield range(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores, so that it doesn't clash with a column of df."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def transcode(df: DataFrame, path: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds the ids of each whole text by the transducer, and the text that the decoder's state machine makes of them.

    Names that are taken get underscores.

    df: any columns (keep: which to pass on; all by default). Null and empty texts: no ids, empty decoded text.
    No shuffle; a worker holds a batch of rows and a bounded memo of chunks.
    """
    keep = df.columns if keep is None else keep
    kept = df.select(*keep)
    ids, decoded = free_name(kept, ids), free_name(kept, decoded)
    rows = df.select(*keep, F.col(text_col).alias(free_name(kept, "__text")))
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast, enc = fast_ids(path), encoder(path)
        for batch in batches:
            texts = batch.column(n_keep).to_pylist()
            for part in slices(texts):
                blobs = [fast(texts[i]) for i in part]
                lens = np.fromiter((len(b) // 4 for b in blobs), np.int64, len(blobs))
                flat = np.frombuffer(b"".join(blobs), dtype="<i4")
                out = []
                for b in blobs:
                    d, own = enc.decoder(), np.frombuffer(b, dtype="<u4")
                    said = [d.feed_many(own[k : k + DECODE_IDS].tolist()) for k in range(0, len(own), DECODE_IDS)]
                    out.append("".join([*said, d.finish()]))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(flat))
                own = batch.slice(part.start, len(part))
                yield pa.RecordBatch.from_arrays([*[own.column(k) for k in range(n_keep)], lists, pa.array(out, pa.string())], names=[*keep, ids, decoded])

    return rows.mapInArrow(run, schema)
