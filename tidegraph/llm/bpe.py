"""Byte-level BPE as a streaming transducer.

A token sequence is the BPE of its bytes iff every two neighbours are the BPE of their own
concatenation.  So the encoding of a prefix is known by its last token alone, and a table
"last token of the prefix that ends here" is filled left to right.  The encoding of any longer
text passes one of the last L prefix ends (L: bytes of the longest token).  What all of these
have in common on their way back is stable and is emitted; that bounds the lookahead by the
merge list, not by the text. L is computed from the merges: the longest token that is the encoding
of its own bytes, as no other can occur. Texts are fed in pieces and cut into pre-tokens as they come;
a pre-token of any length streams through the table, so memory does not grow with the text.
"""

from __future__ import annotations

import base64
import codecs
import re
import struct

import regex

#: Fixed value: the pre-token pattern of the public byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same in Python's own syntax, for texts whose characters both class alike.
_FAST = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_FULL = regex.compile(PATTERN)
_ODD = re.compile("[\x1c-\x1f]")  # white space to Python only

PIECE = 8_192  # characters fed at a time
HELD = 1_024  # characters of a pre-token that are held before it streams
MEMO = 300_000  # entries of each memo; emptied when full, so memory stays constant
KEEP = 64  # longest text that a memo keeps
_TIGHT = re.compile(r"\s ")  # white space before a blank: runs of it reach over blanks
_COARSE = re.compile(r" ?\S+|\s+(?!\S)|\s+")

_re_l, _re_n, _re_s = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"\s")
_fu_l, _fu_n, _fu_s = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\s")
#: The rest of a pre-token by its kind.
_RUN = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "S": regex.compile(r"\s*"), "O": regex.compile(r"[^\s\p{L}\p{N}]*")}


def _class(c: str, l, n, s) -> int:
    return 1 if l.match(c) else 2 if n.match(c) else 3 if s.match(c) else 0


class _Alike(dict):
    """Per character: do Python's re and the pattern class it alike?"""

    def __missing__(self, c: str) -> bool:
        self[c] = same = _class(c, _re_l, _re_n, _re_s) == _class(c, _fu_l, _fu_n, _fu_s)
        return same


_alike = _Alike()


def split(text: str) -> list[str]:
    """The pre-tokens of a text."""
    return (_FAST if all(map(_alike.__getitem__, set(text))) else _FULL).findall(text)


class Memo(dict):
    """Text to packed ids, made on demand and kept if short."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        if len(text) <= KEEP:
            if len(self) >= MEMO:
                self.clear()
            self[text] = ids
        return ids


class Bpe:
    """Encoder of one rank file; ids are ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.lookahead = self._lookahead()
        tails: dict[bytes, set[int]] = {}
        for t in self.ranks:
            tails.setdefault(t[-2:], set()).add(len(t))
        self.tails = {k: sorted(v, reverse=True) for k, v in tails.items()}  # lengths of the tokens that end so
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self.words = Memo(self._word)  # pre-tokens
        self.chunks = Memo(self._chunk)  # blank-free texts that a blank precedes

    def _word(self, text: str) -> bytes:
        return struct.pack(f"<{len(ids := self.word(text.encode('utf-8', 'replace')))}i", *ids)

    def _chunk(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, split(" " + text)))

    def _lookahead(self) -> int:
        """Bytes of the longest token that the merges make of its own bytes; no later byte changes what lies farther back."""
        for t in sorted(self.ranks, key=len, reverse=True):
            if self.merge(t) == [t]:
                return len(t)
        return 1

    # -- one pre-token ------------------------------------------------------
    def merge(self, word: bytes) -> list[bytes]:
        """The definition: join the neighbours of lowest rank until none is left."""
        if word in self.ranks and len(word) <= 2:
            return [word]
        parts = [word[i : i + 1] for i in range(len(word))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = 1 << 60, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            a, b = parts[at], parts[at + 1]
            out, i, n = [], 0, len(parts)
            while i < n:
                if i + 1 < n and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def word(self, word: bytes) -> list[int]:
        s = Stream(self)
        return s.feed(word) + s.finish()

    def fits(self, a: bytes, b: bytes) -> bool:
        """a, b are neighbours in an encoding."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= MEMO:
                self._pairs.clear()
            known = self._pairs[(a, b)] = self.merge(a + b) == [a, b]
        return known

    # -- whole texts --------------------------------------------------------
    def packed(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers; none for an empty text and for null."""
        if not text:
            return b""
        t = Text(self)
        return b"".join([t.feed(text[i : i + PIECE]) for i in range(0, len(text), PIECE)]) + t.finish()

    def part(self, text: str) -> bytes:
        """Ids of a text that ends where a pre-token ends.

        A pre-token starts at every blank that no white space precedes, so the parts between
        blanks are encoded apart, each by the memo if it was seen before."""
        if not text:
            return b""
        if _ODD.search(text):
            return b"".join(map(self.words.__getitem__, split(text)))
        if _TIGHT.search(text):
            return b"".join([self.chunks[x[1:]] if x[0] == " " and len(x) > 1 and not x.isspace() else self._plain(x) for x in _COARSE.findall(text)])
        first, *rest = text.split(" ")
        return self._plain(first) + b"".join(map(self.chunks.__getitem__, rest))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, split(text)))

    def encode(self, text: str | None) -> list[int]:
        return list(memoryview(self.packed(text)).cast("i"))

    def count(self, text: str | None) -> int:
        return len(self.packed(text)) // 4

    def decode(self, ids: list[int]) -> str:
        d = Decoder(self)
        return d.feed(ids) + d.finish()


class Stream:
    """Feeds a pre-token's bytes in pieces; emits ids as soon as no continuation can change them."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.base = bpe, 0
        self.data = bytearray()  # bytes not yet emitted
        self.last: list[int] = [0]  # last[i]: length of the last token of data[:i]

    def _token(self, end: int) -> bytes:
        return bytes(self.data[end - self.last[end] : end])

    def feed(self, piece: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(piece), 256):
            out += self._feed(piece[i : i + 256])
        return out

    def _feed(self, piece: bytes) -> list[int]:
        b = self.bpe
        ranks = b.ranks
        for byte in piece:
            self.data.append(byte)
            end = len(self.data)
            for n in (*b.tails.get(bytes(self.data[-2:]) if end > 1 else b"", ()), 1):
                start = end - n
                if start < 0:
                    continue
                tok = bytes(self.data[start:end])
                if tok not in ranks:
                    continue
                if start == 0:
                    if b.merge(tok) == [tok]:
                        self.last.append(n)
                        break
                elif b.fits(self._token(start), tok):
                    self.last.append(n)
                    break
            else:
                raise ValueError("a byte is missing in the vocabulary")
        return self._emit()

    def _path(self, end: int) -> list[int]:
        at = []
        while end:
            at.append(end)
            end -= self.last[end]
        return at[::-1]

    def _emit(self) -> list[int]:
        end = len(self.data)
        alive = set(range(max(1, end - self.bpe.lookahead + 1), end + 1))
        if end < self.bpe.lookahead:
            return []
        # the deepest position that the ways back of all open ends share; the last token before it stays as context
        while len(alive) > 1:
            top = max(alive)
            alive.discard(top)
            alive.add(top - self.last[top])
        stable = alive.pop()
        if not stable:
            return []
        cuts = self._path(stable)
        if len(cuts) < 2:
            return []
        keep = cuts[-2]
        ids, at = [], 0
        for c in cuts[:-1]:
            ids.append(self.bpe.ranks[bytes(self.data[at:c])])
            at = c
        del self.data[:keep]
        self.last = [0] + self.last[keep + 1 :]
        # ends inside the kept part that lead before it are on no way that is still open
        self.last = [min(n, i) if n <= i else i for i, n in enumerate(self.last)]
        return ids

    def finish(self) -> list[int]:
        ids, at = [], 0
        for c in self._path(len(self.data)):
            ids.append(self.bpe.ranks[bytes(self.data[at:c])])
            at = c
        self.data, self.last = bytearray(), [0]
        return ids


class Text:
    """Feeds a text in pieces of any size; gives packed ids as soon as they are certain.

    Held back are the characters from the last blank that ends a word on, or the end of a long pre-token."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.rest = bpe, ""
        self.open: Stream | None = None
        self.kind, self.held = "", ""

    def _send(self, text: str) -> bytes:
        ids = self.open.feed(text.encode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}i", *ids)

    def _close(self) -> bytes:
        ids = self.open.finish()
        self.open = None
        return struct.pack(f"<{len(ids)}i", *ids)

    def _go_on(self, piece: str) -> tuple[bytes, str]:
        """Ids of the rest of the open pre-token, and what of the piece comes after it."""
        n = _RUN[self.kind].match(piece).end()
        run, after = piece[:n], piece[n:]
        if self.kind == "S" and n:  # the last white space may belong to the next pre-token
            run, self.held = self.held + run[:-1], run[-1]
        out = self._send(run)
        if not after:
            return out, ""
        after, self.held = self.held + after, ""
        return out + self._close(), after

    def feed(self, piece: str) -> bytes:
        out = b""
        if self.open is not None:
            out, piece = self._go_on(piece)
            if self.open is not None:
                return out
        s = self.rest + piece
        at = s.rfind(" ", 1)
        while at > 0 and s[at - 1].isspace():
            at = s.rfind(" ", 1, at)
        if at > 0:
            out += self.bpe.part(s[:at])
            s = s[at:]
        if len(s) > HELD:
            more, s = self._begin(s)
            out += more
        self.rest = s
        return out

    def _begin(self, s: str) -> tuple[bytes, str]:
        """Ids of the pre-tokens of s that no continuation changes, and the rest; a long last one is opened."""
        found = _FULL.findall(s)
        at, done = 0, 0
        for x in found[:-1]:
            if at + len(x) > len(s) - 3:  # 're and its like may be incomplete
                break
            at += len(x)
            done += 1
        out = b"".join(map(self.bpe.words.__getitem__, found[:done]))
        s = s[at:]
        if done < len(found) - 1 or len(s) <= HELD:
            return out, s
        c = s[1] if s[0] == " " else s[0]
        self.kind = next((k for k, r in zip("LNS", (_fu_l, _fu_n, _fu_s)) if r.match(c)), "O")
        self.open = Stream(self.bpe)
        if self.kind == "S":
            s, self.held = s[:-1], s[-1]
        return out + self._send(s), ""

    def finish(self) -> bytes:
        if self.open is not None:
            out = self._send(self.held) if self.held else b""
            self.held = ""
            return out + self._close()
        s, self.rest = self.rest, ""
        return self.bpe.part(s)


class Decoder:
    """Ids to text in pieces: keeps at most the three bytes of an unfinished character."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.machine.decode(b"".join([self.bpe.tokens[int(i)] for i in ids]))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One encoder per process and file."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]
