"""BPE encoding by a depth-first walk of the trie of distinct words.

The distinct pre-tokens of a stretch of text are put in order, which lays the
trie of all of them out depth first: a word's path shares its first ``lcp``
symbols with the path of the word before it.  For every node the walk keeps two
numbers: the *last token* of the encoding of the node's prefix, and the longest
suffix of it that begins a token (an Aho-Corasick state, which lists the tokens
that end there).  An encoding of ``prefix`` is the encoding of ``prefix[:-len(t)]``
followed by ``t``, for the one suffix ``t`` that is in the vocabulary and stays
apart from the token before it, so a node needs only its ancestors' numbers, and
the states of a shared prefix are computed once for all words below it.

Token ids must grow with merge rank (true of the two vocabularies used here and
checked at load).
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex

from .common import _CLEAR, claim

WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LATIN_L = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_LATIN_N = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_GPT = " ?[{L}]+| ?[{N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{W}{L}{N}]+|[{W}]+(?![^{W}])|[{W}]+"
_WORD = "[{L}]+|[{N}]|'(?:s|t|re|ve|m|ll|d)|[^{W}{L}{N}]+"
#: Characters of a text that are taken apart at a time, which bounds the memory; nothing is left out.
PIECE = 1 << 20
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What each code point is to the patterns above."""
    out = np.full(0x110000, _OTHER, np.uint8)
    points = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])
    chars = points.tobytes().decode("utf-32-le")
    for kind, shape in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, f"[{WS}]+")):
        for m in regex.finditer(shape, chars):
            out[points[m.start() : m.end()]] = kind
    return out


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of ``_WORD`` begin in UTF-8 bytes in lower case, and the bytes that are in one."""
    kind = _kinds()[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        top, point = raw[lead].astype(np.int32), np.zeros(len(lead), np.int32)
        size = 2 + (top >= 0xE0) + (top >= 0xF0)
        for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
            of = np.flatnonzero(size == n)
            x = top[of] & mask
            for k in range(1, n):
                x = x << 6 | (raw[lead[of] + k] & 0x3F)
            point[of] = x
        known = _kinds()[point]
        for k in range(4):
            of = size > k
            kind[lead[of] + k] = known[of]
    inside = kind != _SPACE
    begins = inside.copy()
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    if len(lead):
        begins &= (raw & 0xC0) != 0x80
    at = np.flatnonzero(raw == 39)
    at = at[begins[at]]
    if len(at):
        after = np.concatenate([raw, np.zeros(3, np.uint8)])
        x, y = after[at + 1], after[at + 2]
        one, two = np.isin(x, list(b"stmd")), (np.isin(x, list(b"rv")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        begins[at[one | two] + 1] = False
        rest = np.concatenate([at[one] + 2, at[two] + 3])
        rest = rest[rest < len(raw)]
        begins[rest[kind[rest] == _LETTER]] = True
    return np.flatnonzero(begins), inside


def _byte_chars() -> dict[str, int]:
    """Printable stand-ins of the byte-level alphabet, to bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieBPE:
    """Encoder and decoder of one byte-level tokenizer file.

    Two layouts are known: the byte-level one in which white space belongs to the
    words, and the one with word-end symbols, lower-cased, without white space.
    ``memo_words`` bounds each table of encoded words that a worker keeps (one of
    strings, one of bytes); it changes the speed alone.
    """

    def __init__(self, path: str, memo_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], _byte_chars()
        self.end = model.get("end_of_word_suffix") or ""
        self.lower = bool(self.end)
        vocab = model["vocab"]
        self.plain: dict[bytes, int] = {}
        self.ended: dict[bytes, int] = {}
        n = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.token_bytes: list[bytes] = [b""] * n
        self.length = [1] * n
        for token, i in vocab.items():
            whole = bool(self.end) and token.endswith(self.end)
            raw = bytes(chars[c] for c in (token[: -len(self.end)] if whole else token))
            (self.ended if whole else self.plain)[raw] = i
            self.token_bytes[i], self.length[i] = raw, len(raw)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.pair: dict[int, int] = {}
        self.left, self.right = list(range(n)), list(range(n))
        last = -1
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z <= last:
                raise ValueError("token ids don't follow the merge ranks")
            last = z
            self.pair[x << 20 | y] = z
            self.left[z], self.right[z] = x, y
        self._apart: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._begin_states()
        self.words: dict[str, bytes] = {s: array("H", [i]).tobytes() for s, i in self.special.items()}
        self.raw_words: dict[bytes, bytes] = {}
        self.memo_words = memo_words
        shape = _WORD if self.end else _GPT
        self._latin = re.compile(shape.format(L=_LATIN_L, N=_LATIN_N, W=WS))
        self._any = regex.compile(shape.format(L=r"\p{L}", N=r"\p{N}", W=WS))
        self._seam = re.compile(f"(?<=[^{WS}]) (?=[^{WS}])")
        self._beyond = re.compile("[^\x00-\u024f]")
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        if self.end and "Σ".lower() != "σ":
            raise AssertionError

    # -- the tokens that end at a place ------------------------------------
    def _begin_states(self) -> None:
        self._prefix = {t[:k] for d in (self.plain, self.ended) for t in d for k in range(1, len(t) + 1)}
        self._name, self._number = [b""], {b"": 0}
        self._next: dict[int, int] = {}
        self._outs: list[list[tuple[int, int]]] = [[]]
        self._ends: list[list[tuple[int, int]]] = [[]]

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte, worked out when it is first needed."""
        name = self._name[state] + bytes([byte])
        while name and name not in self._prefix:
            name = name[1:]
        new = self._number.get(name)
        if new is None:
            new = self._number[name] = len(self._name)
            self._name.append(name)
            for table, outs in ((self.plain, self._outs), (self.ended, self._ends)):
                outs.append([(table[x], len(x)) for x in (name[j:] for j in range(len(name))) if x in table])
        if len(self._next) > 1_000_000:
            self._next.clear()
        self._next[state << 8 | byte] = new
        return new

    # -- the walk ---------------------------------------------------------
    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves tokens a and b, next to each other, as they are."""
        key = a << 20 | b
        if (known := self._apart.get(key)) is not None:
            return known
        pair, left, right, limit = self.pair, self.left, self.right, 1 << 40
        x, y = a, b
        while True:
            z = pair.get(x << 20 | y)
            if z is not None and z < limit:
                out = False
                break
            if x > y:
                limit = x
                x = right[x]
                if x == limit:
                    limit = y + 1
                    y = left[y]
                    if y + 1 == limit:
                        out = True
                        break
            else:
                limit = y + 1
                y = left[y]
                if y + 1 == limit:
                    limit = x
                    x = right[x]
                    if x == limit:
                        out = True
                        break
        if len(self._apart) > 400_000:
            self._apart.clear()
        self._apart[key] = out
        return out

    def whole(self, t: int) -> bool:
        """Whether the token's own text is encoded as that one token."""
        known = self._whole.get(t)
        if known is None:
            a, b = self.left[t], self.right[t]
            known = a == t or (self.whole(a) and self.whole(b) and self._reached(t))
            self._whole[t] = known
        return known

    def _reached(self, t: int) -> bool:
        parts = list(self.token_bytes[t])
        ids = [self.plain[bytes([b])] for b in parts]
        if self.end and self.ended.get(self.token_bytes[t]) == t:
            ids[-1] = self.ended[bytes([parts[-1]])]
        while len(ids) > 1:
            best, at = min((self.pair.get(x << 20 | y, 1 << 40), k) for k, (x, y) in enumerate(zip(ids, ids[1:])))
            if best == 1 << 40:
                return False
            ids[at : at + 2] = [best]
        return ids == [t]

    def walk(self, words: list[bytes]) -> Iterator[bytes]:
        """Token ids (16 bits each) of each of the words, which must be sorted and not empty."""
        outs, ends, step, nxt = self._outs, self._ends, self._step, self._next.get
        apart, whole, known, length = self.apart, self.whole, self._apart.get, self.length
        closed = bool(self.ended)
        last, states = [0], [0]  # of the path: the last token and the state of each prefix, by its length
        before = b""
        for word in words:
            n = len(word)
            stop = n - 1 if closed else n
            k, most = 0, min(len(before), stop, len(last) - 1)
            if before[:most] == word[:most]:
                k = most
            else:
                while before[k] == word[k]:
                    k += 1
            del last[k + 1 :], states[k + 1 :]
            s = states[k]
            for i in range(k, stop):
                c = word[i]
                s = x if (x := nxt(s << 8 | c)) is not None else step(s, c)
                states.append(s)
                for t, size in outs[s]:
                    if size <= i:
                        p = last[i + 1 - size]
                        ok = known(p << 20 | t)
                        if ok or ok is None and apart(p, t):
                            break
                    elif whole(t):
                        break
                last.append(t)
            if closed:
                c = word[n - 1]
                s = x if (x := nxt(s << 8 | c)) is not None else step(s, c)
                for t, size in ends[s]:
                    if apart(last[n - size], t) if size < n else whole(t):
                        break
                ids, i = [t], n - size
            else:
                ids, i = [], n
            while i:
                t = last[i]
                ids.append(t)
                i -= length[t]
            ids.reverse()
            yield array("H", ids).tobytes()
            before = word

    # -- text -------------------------------------------------------------
    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of about PIECE characters, cut where no pre-token crosses."""
        at = 0
        while len(text) - at > PIECE and not any(" " in x for x in self.special) and (seam := self._seam.search(text, at + PIECE)):
            yield text[at : seam.start()]
            at = seam.start()
        yield text[at:] if at else text

    @staticmethod
    def normal(text: str) -> str:
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens (normalised, where the layout says so)."""
        if self.lower:
            text = self.normal(text)
        return (self._latin if text.isascii() or not self._beyond.search(text) else self._any).findall(text)

    def parts(self, text: str) -> list[str]:
        """The pre-tokens and special tokens of a text."""
        if not self._specials or "<|" not in text:
            return self.cut(text)
        out = []
        for s in self._specials.split(text):
            out += [s] if s in self.special else self.cut(s)
        return out

    def learn(self, parts: set[str]) -> None:
        """Encode the pre-tokens that aren't known yet."""
        words = self.words
        if new := parts.difference(words):
            if len(words) + len(new) > self.memo_words:  # keep the words met first, which are the common ones
                self.words = words = dict(islice(words.items(), self.memo_words // 2))
                new = parts.difference(words)
            order = sorted([(p.encode("utf-8", "replace"), p) for p in new])
            for (_, p), ids in zip(order, self.walk([w for w, _ in order])):
                words[p] = ids

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint16 ids of each text as a tokenizer with its special tokens gives them; null: as the empty text."""
        if any(t and len(t) > PIECE for t in texts):
            return [np.concatenate([self._encode_batch([x])[0] for x in self.pieces(t or "")]) for t in texts]
        return self._encode_batch(texts)

    def _encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.parts(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), np.uint16) for p in cut]

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """What encode_batch gives, one text after the other, and where each ends.

        In the layout without white space the pre-tokens are found and numbered by
        arrays of the bytes, so that no object is made of one that is there again.
        """
        if not self.lower:
            each = self.encode_batch(texts)
            return np.concatenate([*each, np.empty(0, np.uint16)]), np.cumsum([len(x) for x in each], dtype=np.int64)
        apart = {i: self.encode_batch([t])[0] for i, t in enumerate(texts) if t and (len(t) > PIECE or self._specials and "<|" in t)}
        raws = [self.normal(t).encode("utf-8", "replace") if t and i not in apart else b"" for i, t in enumerate(texts)]
        stops = np.cumsum([len(r) + 1 for r in raws])  # with the line end after each
        joined = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
        begins, inside = _words(joined)
        if len(begins):
            at = np.append(np.cumsum(inside, dtype=np.int32)[begins] - 1, np.int32(np.count_nonzero(inside))).astype(np.int32)
            numbered = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(at), pa.py_buffer(joined[inside])]).dictionary_encode()
            number = numbered.indices.to_numpy()
            known = self.learn_raw(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
            size = np.fromiter(map(len, known), np.int64, len(known)) >> 1
            table, start = np.frombuffer(b"".join(known), np.uint16), np.cumsum(size) - size
            size = size[number]
            ends = np.cumsum(size)
            ids = table[np.repeat(start[number] - ends + size, size) + np.arange(ends[-1])]
            ends = np.concatenate([[0], ends])[np.searchsorted(begins, stops)]
        else:
            ids, ends = np.empty(0, np.uint16), np.zeros(len(texts), np.int64)
        if apart:
            each = [apart.get(i, x) for i, x in zip(range(len(texts)), np.split(ids, ends))]
            ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        return ids, ends

    def learn_raw(self, raws: list[bytes]) -> list[bytes]:
        """The ids (16 bits each) of distinct pre-tokens given as UTF-8."""
        words = self.raw_words
        out = list(map(words.get, raws))
        if missing := [i for i, ids in enumerate(out) if ids is None]:
            missing.sort(key=raws.__getitem__)
            new = [raws[i] for i in missing]
            if len(words) + len(new) > self.memo_words:  # as in learn
                self.raw_words = words = dict(islice(words.items(), self.memo_words // 2))
            for i, word, ids in zip(missing, new, self.walk(new)):
                out[i] = words[word] = ids
        return out

    def counts(self, parts: list[str]) -> list[int]:
        """The number of tokens of each of the pre-tokens."""
        try:
            return [n >> 1 for n in map(len, map(self.words.__getitem__, parts))]
        except KeyError:
            self.learn(set(parts))
            return [n >> 1 for n in map(len, map(self.words.__getitem__, parts))]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        """Special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _loaded(path: str) -> TrieBPE:
    return TrieBPE(path)


_CLEAR.append(_loaded.cache_clear)


def load(path: str) -> TrieBPE:
    """One encoder a worker process, so that its table of words outlives a task."""
    claim("bpe")
    return _loaded(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
