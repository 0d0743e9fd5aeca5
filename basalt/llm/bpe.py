"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its incremental decoder.

The transducer keeps, for every prefix of a word, the last token of that prefix's encoding. A sequence of tokens
is the encoding of its text exactly when each neighbouring pair is (no merge across the border would have been
chosen first), so the last token of a longer prefix follows from those of the shorter ones. The encodings of the
last `longest` prefixes form a tree, and later tokens attach only there. `sufficient_lookahead()` tells, from the merge
list alone, how far right of a token the text can still change it. A token is stable, and is emitted and forgotten,
once so many symbols after it have been read, or the word has ended (no merge crosses words); it must stand on the
tree's common trunk, too, which holds the bound to account. So what is held of a word is bounded by the lookahead.

Both file kinds are read from the tokenizers library's JSON: byte-level BPE, and word BPE with an end-of-word
suffix (lower case, white space dropped). Null texts encode as the empty text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import regex

from .common import held

BASE = -1
#: Words and prefixes that a worker remembers; symbols between two looks for stable tokens.
MEMO_WORDS, STEP = 400_000, 16
#: Word pattern of the word-BPE files, and of byte-level BPE. Fixed values.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BYTE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Unicode's White_Space; str.split() also takes U+001C to U+001F.
SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
ODD_SPACES = re.compile("[\x1c-\x1f]")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, nxt = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(nxt))
            nxt += 1
    return out


BYTE_CHARS = byte_chars()
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}
_TO_CHARS = {b: c for b, c in enumerate(BYTE_CHARS)}


def as_byte_chars(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_TO_CHARS)


_UNSETTLED: list[re.Pattern] = []


def unsettled(text: str) -> bool:
    """Has the text code points that this Python's Unicode doesn't assign, or of private use?"""
    if text.isascii():
        return False
    if not _UNSETTLED:
        runs, start = [], None
        for c in range(0x110001):
            odd = c < 0x110000 and unicodedata.category(chr(c)) in ("Cn", "Co")
            if odd and start is None:
                start = c
            elif not odd and start is not None:
                runs.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        _UNSETTLED.append(re.compile(f"[{''.join(runs)}]"))
    return _UNSETTLED[0].search(text) is not None


class MergeTable:
    """A vocabulary and its ranked merges."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank: dict[tuple[str, str], int] = {}
        self.split: dict[str, tuple[str, str]] = {}
        self.born: dict[str, int] = {}
        for i, (a, b) in enumerate(merges):
            self.rank[a, b] = i
            if a + b not in self.born:
                self.born[a + b], self.split[a + b] = i, (a, b)
        self.longest = max((self.symbol_count(t) for t in self.born), default=1)
        self.ends: set[str] = set()  # whatever some token ends with
        for t in self.vocab:
            n, stop = len(t), len(t) - len(suffix) if suffix and t.endswith(suffix) and t != suffix else len(t)
            self.ends.update(t[i:n] for i in range(stop))
        self._lookahead: int | None = None
        self._proper: dict[str, bool] = {}
        self._pair: dict[tuple[str, str], bool] = {}

    def symbol_count(self, token: str) -> int:
        n = len(token)
        return n - len(self.suffix) if self.suffix and token.endswith(self.suffix) and n > len(self.suffix) else n

    def symbols(self, word: str) -> list[str]:
        out = list(word)
        if out and self.suffix:
            out[-1] += self.suffix
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: lowest rank first, leftmost first."""
        parts = list(symbols)
        while len(parts) > 1:
            best, at = min(((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def proper(self, token: str, symbols: list[str]) -> bool:
        """Does the token's own text encode as this one token?"""
        if (known := self._proper.get(token)) is None:
            known = self._proper[token] = self.merge(symbols) == [token]
        return known

    def compatible(self, left: str, right: str) -> bool:
        """Would BPE leave these neighbours apart? Undo the later of their merges, and look for an earlier one across."""
        key = (left, right)
        if (known := self._pair.get(key)) is not None:
            return known
        limit, answer = 1 << 60, True
        while True:
            across = self.rank.get((left, right))
            if across is not None and across < limit:
                answer = False
                break
            a, b = self.born.get(left, BASE), self.born.get(right, BASE)
            if a > b:
                limit, left = a, self.split[left][1]
            elif b > BASE:
                limit, right = b + 1, self.split[right][0]  # of equal merges, the left one comes first
            else:
                break
        if len(self._pair) > 1_000_000:
            self._pair.clear()
        self._pair[key] = answer
        return answer

    def sufficient_lookahead(self) -> int:
        """Symbols right of a merge that can still change it.

        A merge (u, v) is pre-empted from the right only by an earlier rule (x, y) whose x ends v's text at that
        time: v or a token down its right edge. That rule needs |y| more symbols, and its own lookahead.
        """
        if self._lookahead is not None:
            return self._lookahead
        best: dict[str, int] = {}
        longest = 0
        for (a, b), _ in sorted(self.rank.items(), key=lambda x: x[1]):
            need, edge = 0, b
            while True:
                need = max(need, best.get(edge, 0))
                if edge not in self.split:
                    break
                edge = self.split[edge][1]
            longest = max(longest, need)
            best[a] = max(best.get(a, 0), self.symbol_count(b) + need)
        self._lookahead = longest
        return longest


class Transducer:
    """Encodes one word symbol by symbol; yields each token as soon as it is stable."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.lookahead = max(table.sufficient_lookahead(), table.longest)
        self.held_most = 0
        self.states: dict[str, str] = {}
        self.reset()

    def reset(self) -> None:
        self.symbols: list[str] = []  # since the last committed border
        self.last: list[str] = []  # last token of the encoding of each held prefix
        self.before: str | None = None  # the token left of the committed border

    def _last_token(self, held: list[str], last: list[str]) -> str:
        """Last token of the encoding of all of `held`, from those of its prefixes."""
        t = self.table
        n, token = len(held), ""
        for start in range(n - 1, max(-1, n - 1 - t.longest), -1):
            token = held[start] + token
            if token not in t.ends:
                break
            if start == n - 1:
                ok = token in t.vocab
            elif (ok := t._proper.get(token)) is None:
                ok = token in t.born and t.proper(token, held[start:n])
            if ok:
                left = last[start - 1] if start else self.before
                if left is None or t.compatible(left, token):
                    return token
        raise ValueError(f"no token covers {held[-1]!r}")

    def feed(self, symbol: str) -> Iterator[str]:
        held = self.symbols
        held.append(symbol)
        n = len(held)
        self.last.append(self._last_token(held, self.last))
        self.held_most = max(self.held_most, n)
        if n >= self.lookahead + STEP and n % STEP == 0:
            yield from self._commit()

    def _width(self, token: str) -> int:
        return self.table.symbol_count(token)

    def _commit(self) -> Iterator[str]:
        """The tokens that end `lookahead` symbols back or before: what is yet to come can't change them."""
        n = len(self.symbols)
        live = set(range(max(0, n - self.table.longest + 1), n + 1))  # prefix lengths that a later token can follow
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(top - self._width(self.last[top - 1]))
        end = 0
        for token in self._path(live.pop()):
            if end + self._width(token) > n - self.lookahead:
                break
            yield token
            end += self._width(token)
            self.before = token
        del self.symbols[:end], self.last[:end]

    def _path(self, end: int) -> list[str]:
        out = []
        while end:
            out.append(self.last[end - 1])
            end -= self._width(out[-1])
        return out[::-1]

    def finish(self) -> list[str]:
        out = self._path(len(self.symbols))
        self.reset()
        return out

    def word(self, word: str) -> Iterable[str]:
        """Tokens of a word. Within the lookahead only a word's end makes tokens stable: short ones share their states."""
        return self._short(word) if len(word) <= min(self.lookahead, 2 * self.table.longest) else self._long(word)

    def _short(self, word: str) -> list[str]:
        """The same states, remembered by prefix: words share them."""
        t, states = self.table, self.states
        ends, born, vocab, proper, pairs, longest = t.ends, t.born, t.vocab, t._proper, t._pair, t.longest
        n = len(word)
        last: list[str] = []
        for i in range(1, n + 1):
            final = t.suffix if i == n else ""
            if not final and (found := states.get(word[:i])) is not None:
                last.append(found)
                continue
            found = None
            for start in range(i - 1, max(-1, i - 1 - longest), -1):
                token = word[start:i] + final
                if token not in ends:
                    break
                if start == i - 1:
                    ok = token in vocab
                elif (ok := proper.get(token)) is None:
                    ok = token in born and t.proper(token, [*word[start : i - 1], word[i - 1] + final])
                if ok:
                    if not start:
                        found = token
                        break
                    left = last[start - 1]
                    if (fits := pairs.get((left, token))) is None:
                        fits = t.compatible(left, token)
                    if fits:
                        found = token
                        break
            if found is None:
                raise ValueError(f"no token covers {word[i - 1]!r}")
            last.append(found)
            if not final:
                if len(states) >= MEMO_WORDS:
                    states.clear()
                states[word[:i]] = found
        out, end = [], n
        while end:
            out.append(token := last[end - 1])
            end -= len(token) if end < n else self._width(token)
        return out[::-1]

    def _long(self, word: str) -> Iterator[str]:
        suffix = self.table.suffix
        for i, c in enumerate(word):
            yield from self.feed(c + suffix if i == len(word) - 1 else c)
        yield from self.finish()


class Decoder:
    """Ids to text by an incremental state machine: what is complete leaves at once.

    'words': token strings joined by one space, as the library does without a decoder. 'bytes': tokens are
    stand-ins of bytes; the state is an unfinished UTF-8 sequence of at most three bytes, and what can't be
    completed becomes U+FFFD.
    """

    def __init__(self, names: list[str], kind: str, special: frozenset[int] = frozenset()):
        import codecs

        self.names, self.kind, self.special = names, kind, special
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self._first = True

    def feed(self, i: int) -> str:
        if self.kind == "words":
            out = self.names[i] if self._first else " " + self.names[i]
            self._first = False
            return out
        if i in self.special:
            return self._utf8.decode(self.names[i].encode())
        return self._utf8.decode(bytes(CHAR_BYTES[c] for c in self.names[i]))

    def feed_many(self, ids) -> str:
        if self.kind == "words":
            out = " ".join(map(self.names.__getitem__, ids))
            out, self._first = (out, False) if self._first or not ids else (" " + out, False)
            return out
        return "".join(map(self.feed, ids))

    def finish(self) -> str:
        self._first = True
        return self._utf8.decode(b"", True)


class Memo(dict):
    """A bounded memo of a pure function, in two generations: when the young one is full, it becomes the old one."""

    def __init__(self, make, cap: int):
        super().__init__()
        self.make, self.cap, self.old = make, cap, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.cap:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


class Encoder:
    """A tokenizer file: splits text into chunks that encode independently, each chunk into ids.

    A chunk is a run without white space (word files), or a space and such a run (byte-level files); no match of
    the word pattern crosses their borders. Texts where that can't be told by a plain split take the pattern.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.kind = "words" if self.suffix else "bytes"
        self.table = MergeTable(model["vocab"], merges, self.suffix)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = tuple(self.special)
        names = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.transducer = Transducer(self.table)

    def normalise(self, chunk: str) -> str:
        """NFC, then lower case character by character (no final-sigma rule)."""
        if chunk.isascii():
            return chunk.lower()
        chunk = unicodedata.normalize("NFC", chunk)
        return "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()

    def word_ids(self, word: str) -> list[int]:
        """Ids of one match of the word pattern, by the transducer."""
        vocab = self.table.vocab
        return [vocab[t] for t in self.transducer.word(word if word.isascii() and " " not in word and word.isprintable() else as_byte_chars(word))]

    def pieces(self, chunk: str) -> list[str]:
        """The matches of the word pattern in a chunk."""
        if not chunk.isprintable() and unsettled(chunk):
            return self._split_by_library(chunk)
        return WORD.findall(self.normalise(chunk)) if self.kind == "words" else BYTE.findall(chunk)

    def _split_by_library(self, text: str) -> list[str]:
        """Letters differ between versions of Unicode: the library's own splitter tells what it takes for one."""
        lib = library(self.path)
        text = lib.normalizer.normalize_str(text) if lib.normalizer else text
        return [bytes(CHAR_BYTES[c] for c in w).decode() for w, _ in lib.pre_tokenizer.pre_tokenize_str(text)]

    def chunk_ids(self, chunk: str) -> list[int]:
        return [i for w in self.pieces(chunk) for i in self.word_ids(w)]

    def segments(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(special id, []) and (None, chunks), in the text's order."""
        if any(m in text for m in self.marks):
            for part in self.special_split.split(text):
                if part in self.special:
                    yield self.special[part], []
                elif part:
                    yield None, self.chunks(part)
        else:
            yield None, self.chunks(text)

    def chunks(self, text: str) -> list[str]:
        if self.kind == "words":
            return [c for c in SPACES.split(text) if c] if ODD_SPACES.search(text) else text.split()
        if _DOUBLE_SPACE.search(text) or text.endswith(" "):
            return self._split_by_library(text) if unsettled(text) else BYTE.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + c for c in rest]] if first else [" " + c for c in rest]

    def decoder(self) -> Decoder:
        return Decoder(self.names, self.kind, frozenset(self.special.values()))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for special, chunks in self.segments(text or ""):
            if special is not None:
                out.append(special)
            for c in chunks:
                out += self.chunk_ids(c)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        d = self.decoder()
        return "".join(d.feed(i) for i in ids) + d.finish()


_DOUBLE_SPACE = re.compile(r" \s")


def encoder(path: str) -> Encoder:
    """One encoder a process and file."""
    encoders = held("tokens")
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def library(path: str):
    """The tokenizers library's own object for a file, without truncation and padding."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    key, encoders = f"lib:{path}", held("tokens")
    if key not in encoders:
        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        encoders[key] = t
    return encoders[key]
