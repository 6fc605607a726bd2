"""Byte-level BPE as a streaming transducer with bounded look-ahead, and its decoder.

Encoding walks over the bytes of a pre-token once.  For every prefix it keeps
the *last* token of that prefix's encoding.  That is enough: two tokens may
stand side by side in an encoding exactly if merging their joined bytes gives
the two tokens back, and an encoding is any sequence of which all neighbours
may stand so.  Hence the last token of a prefix is the one token that ends there
and may follow the last token of the prefix before it.  Which tokens end at a place
is told by the state of an automaton over the vocabulary, one step a byte.

A later byte changes no prefix's encoding, and a token spans at most
``lookahead`` bytes (the longest entry that the merge list can make), so every
complete encoding continues one of the encodings of the last ``lookahead``
prefixes.  What all of those share is final, and is emitted.  The transducer
therefore holds a window of the text and never the text, however long.

Texts are cut into pre-tokens a window of ``WINDOW`` characters at a time; those that
the rest of the text could still change are read again with the next window.  A
pre-token as long as a window - a run of letters without spaces, say - goes
through the transducer in chunks and is never held as a whole.  So beside the
text itself memory is bounded by the window, whatever the script.

Decoding looks up the bytes of each id and feeds them to a byte-to-text state
machine that holds back at most three bytes of an unfinished character.

The vocabulary file must be byte-level BPE with the pattern below and without
normalizer, prefix space or other options; anything else is refused.

Defined results: a null text encodes as the empty text (no tokens).  Special
tokens written out in a text are matched first, as the tokenizers library does.
Every row gives a row: repeated rows and ties give equal rows (a text that follows
itself, as the copies in a mix do, is encoded once for all of them), an empty
table an empty one, and columns of `docs` other than text and those in `keep`
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from rankweave.llm import kernels as K

# Contractions, and the code points with the White_Space property.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: The pattern of public byte-level BPE for any text, and a faster one for texts in which
#: Python's own classes agree with it: no underscore, no other white space than
#: White_Space, no numeral that is not a decimal digit.
_ANY = regex.compile(rf"{_CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+").findall
_PLAIN = re.compile(rf"{_CONTRACTIONS}| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+").findall
_SPECIAL_CASE = re.compile(r"[_\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0590-\U0010ffff]").search
#: The runs that long pre-tokens are made of: after an optional space, or white space.
_RUNS = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", rf"[^{_WHITE}\p{{L}}\p{{N}}]+", rf"[{_WHITE}]+")]

#: Characters of a text that are cut into pre-tokens at a time.
WINDOW = 1 << 18

#: Tokens of the rows that are gathered before they are handed on.
HELD = 1 << 20

# Settings of a vocabulary file that this encoder follows.
_SETTINGS = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "decoder": {"type": "ByteLevel"},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}


def pre_tokens(text: str) -> list[str]:
    return (_ANY if _SPECIAL_CASE(text) else _PLAIN)(text)


def _byte_letters() -> dict[str, int]:
    """The printable letters that vocabulary files write bytes with."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def check_settings(spec: dict) -> None:
    """Refuse a file that asks for anything but plain byte-level BPE."""
    for name, want in _SETTINGS.items():
        have = spec.get(name) or {}
        if any((have.get(k) or None) != (v or None) for k, v in (want or {"type": None}).items()):
            raise ValueError(f"the vocabulary's {name} is not that of plain byte-level BPE")
    for token in spec["added_tokens"]:
        if any(token.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with options are not supported")


class _Known(dict):
    """Pre-tokens encoded before, in two generations: when the younger is full it takes
    the place of the older, from which what is asked for again moves back."""

    def __init__(self, encode, limit: int) -> None:
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece) or self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class _State(dict):
    """What the bytes read so far can still become part of.  By the next byte: the state
    after it, made when first asked for.  `ends`: (length, id) of the tokens that end here,
    the longest first."""

    __slots__ = ("read", "ends", "after")

    def __init__(self, read: bytes, ends: tuple[tuple[int, int], ...], after) -> None:
        super().__init__()
        self.read, self.ends, self.after = read, ends, after

    def __missing__(self, byte: int) -> _State:
        found = self[byte] = self.after(self.read + bytes((byte,)))
        return found


class Bpe:
    """A vocabulary with its merge list, and the transducer over it."""

    #: Encodings of pre-tokens kept for reuse in each of two generations.
    CACHE = 250_000
    #: Steps between states kept for reuse.
    STEPS = 500_000

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_settings(spec)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.digits = {i: str(i) for i in self.bytes}
        self.split, self.rank = {}, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank.setdefault((self.ids[a], self.ids[b]), rank)
            self.split.setdefault(self.ids[a + b], (self.ids[a], self.ids[b], rank))
        self.lookahead = self._lookahead()
        self._pairs: dict[int, bool] = {}
        self._known = _Known(self._piece, self.CACHE)
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))).finditer if self.special else None
        self._sorted = sorted(self.ids)
        self._states: dict[bytes, _State] = {}
        self._steps = 0

    def _lookahead(self) -> int:
        """Bytes after which a prefix's tokens are decided: the most that any token the
        merge list makes spans, found by following the merges from the single bytes."""
        self.made = {i for t, i in self.ids.items() if len(t) == 1}
        for (a, b), rank in sorted(self.rank.items(), key=lambda x: x[1]):
            # the merge counts if nothing across its border merges before it
            if a in self.made and b in self.made and self._adjacent(a, b, rank):
                self.made.add(self.ids[self.bytes[a] + self.bytes[b]])
        self.ids = {t: i for t, i in self.ids.items() if i in self.made}
        return max(map(len, self.ids), default=1)

    def _state(self, read: bytes) -> _State:
        """The state after some bytes: the longest end of them that begins a token."""
        while read and not self._begins(read):
            read = read[1:]
        if self._steps > self.STEPS:
            self._states.clear()
            self._steps = 0
        self._steps += 1
        found = self._states.get(read)
        if found is None:
            ends = tuple((len(read) - k, self.ids[read[k:]]) for k in range(len(read)) if read[k:] in self.ids)
            found = self._states[read] = _State(read, ends, self._state)
        return found

    def _begins(self, read: bytes) -> bool:
        at = bisect_left(self._sorted, read)
        return at < len(self._sorted) and self._sorted[at].startswith(read)

    # -- neighbours

    def adjacent(self, left: int, right: int) -> bool:
        """Whether `left`, `right` stay two tokens when their bytes are encoded together."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            known = self._pairs[key] = self._adjacent(left, right)
        return known

    def _adjacent(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Undo the merges on both sides of the border, last merge first.  The border
        holds if no pair across it could merge before its sides were completed."""
        while True:
            if self.rank.get((left, right), limit) < limit:
                return False
            a, b = self.split.get(left), self.split.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] > b[2]):
                limit, left = a[2], a[1]
            else:  # of equal merges the left-hand one comes first, so the border's may not equal it
                limit, right = b[2] + 1, b[0]

    # -- encoding

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token given as chunks of bytes, each as soon as it is decided."""
        width, state = self.lookahead, self._state(b"")
        last: list[int] = [-1]  # last token of each of the last `lookahead` prefixes, the oldest first
        start: list[int] = [-1]  # which of those prefixes that token begins after
        base = 0  # prefixes given up so far
        for chunk in chunks:
            for byte in chunk:
                state, n = state[byte], len(last)
                for length, token in state.ends:
                    at = n - length
                    if at >= 0 and (at + base == 0 or (last[at] >= 0 and self.adjacent(last[at], token))):
                        last.append(token)
                        start.append(at)
                        break
                else:
                    last.append(-2)
                    start.append(-1)
                if n >= 4 * width:
                    cut = self._common(last, start, n, width)
                    if cut:
                        yield from self._path(last, start, cut)
                        base += cut
                        last, start = last[cut:], [x - cut for x in start[cut:]]
        yield from self._path(last, start, len(last) - 1)

    @staticmethod
    def _path(last: list[int], start: list[int], at: int) -> list[int]:
        """Tokens of the prefix `at` of those held."""
        out = []
        while at > 0:
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def _common(self, last: list[int], start: list[int], n: int, width: int) -> int:
        """The longest prefix that the encodings of the last `width` prefixes all pass."""
        live = {k for k in range(n - width + 1, n + 1) if last[k] != -2}
        while len(live) > 1:
            at = max(live)
            live.discard(at)
            live.add(start[at])
        return live.pop() if live else 0

    def _short(self, raw: bytes) -> list[int]:
        """The transducer over a pre-token that fits in the window: nothing to emit early."""
        pairs, adjacent, state = self._pairs, self.adjacent, self._state(b"")
        last, start = [-1], [0]
        for end, byte in enumerate(raw, 1):
            state = state[byte]
            for length, token in state.ends:
                at = end - length
                if at:
                    before = last[at]
                    if before < 0:
                        continue
                    fits = pairs.get(before << 32 | token)
                    if not (adjacent(before, token) if fits is None else fits):
                        continue
                last.append(token)
                start.append(at)
                break
            else:
                last.append(-1)
                start.append(0)
        return self._path(last, start, len(raw))

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token, as packed 32-bit numbers."""
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ids.get(raw)
        out = [whole] if whole is not None else self._short(raw) if len(raw) <= self.lookahead else list(self.stream((raw,)))
        return array("i", out).tobytes()

    def _spans(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(from, to, id) of each special token, and of what lies between (-1)."""
        at = 0
        if self._special and any(x in text for x in self.special):
            for m in self._special(text):
                if m.start() > at:
                    yield at, m.start(), -1
                yield m.start(), m.end(), self.special[m[0]]
                at = m.end()
        if at < len(text):
            yield at, len(text), -1

    def windows(self, text: str, window: int | None = None) -> Iterator[np.ndarray]:
        """Ids of the text's pre-tokens, a window at a time."""
        known, window = self._known.__getitem__, window or WINDOW
        for at, end, special in self._spans(text):
            if special >= 0:
                yield np.array([special], dtype=np.int32)
                continue
            while at < end:
                to = min(end, at + window)
                pieces = pre_tokens(text[at:to])
                if to < end:
                    # only the last can look different with more text behind it, and the one before a short one
                    del pieces[-1 - (len(pieces[-1]) < 4) :]
                    if not pieces:
                        run = _Run(text, at, end, window)
                        yield from self._streamed(run)
                        at = run.end
                        continue
                if pieces:
                    yield np.frombuffer(b"".join(map(known, pieces)), dtype=np.int32)
                at = to if to == end else at + sum(map(len, pieces))

    def _streamed(self, run: _Run) -> Iterator[np.ndarray]:
        held: list[int] = []
        for i in self.stream(run):
            held.append(i)
            if len(held) >= 10_000:
                yield np.array(held, dtype=np.int32)
                held = []
        if held:
            yield np.array(held, dtype=np.int32)

    def written(self, ids: list[int]) -> tuple[str, bytes]:
        """Ids as text, and the bytes they stand for."""
        return ",".join(map(self.digits.__getitem__, ids)), b"".join(map(self.bytes.__getitem__, ids))

    def batches(self, text: str, window: int | None = None) -> Iterator[list[tuple[str, bytes]]]:
        """(ids as text, the bytes they stand for) of the text, a window at a time."""
        for ids in self.windows(text, window):
            yield [self.written(ids.tolist())]

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.windows(text or "") for i in ids.tolist()]

    # -- decoding

    def decode(self, ids: Iterable[int]) -> str:
        machine = Utf8()
        return "".join([machine.feed(self.bytes.get(i, b"")) for i in ids]) + machine.end()


class _Run:
    """The bytes of the one pre-token that begins at a place and is about as long as a
    window, in chunks; ``end`` is where it ends, once they are read."""

    def __init__(self, text: str, at: int, end: int, window: int) -> None:
        self.text, self.at, self.stop, self.window, self.end = text, at, end, window, at

    def __iter__(self) -> Iterator[bytes]:
        text, at, stop = self.text, self.at, self.stop
        space = text[at] == " " and _RUNS[3].match(text, at + 1, at + 2) is None
        run = next(r for r in _RUNS if r.match(text, at + space, stop))
        white, at, held = run is _RUNS[3], at + space, " " * space
        while True:
            m = run.match(text, at, min(stop, at + self.window))
            if m is None:
                break
            part, at = held + m[0], m.end()
            # white space before something else leaves its last character to that
            held, part = (part[-1:], part[:-1]) if white else ("", part)
            yield part.encode("utf-8", "surrogatepass")
        if held and at == stop:
            yield held.encode("utf-8", "surrogatepass")
            held = ""
        self.end = at - len(held)


class Utf8:
    """Incremental byte-to-text machine.

    The state is the unfinished character: up to three bytes.  A byte that cannot
    continue it turns the part read so far into U+FFFD and starts anew.
    """

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _open(tail: bytes) -> int:
        """Bytes at the end of `tail` that a later byte may still complete."""
        for k in range(1, min(3, len(tail)) + 1):
            b = tail[-k]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
                if need <= k:
                    return 0
                if k > 1:
                    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
                    if not low <= tail[-k + 1] <= high:
                        return 0
                return k
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        k = self._open(data)
        self.held = data[len(data) - k :]
        return data[: len(data) - k].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One transducer a process and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _digest(bpe: Bpe, text: str, ids_out: list[np.ndarray] | None = None) -> tuple[int, str, str]:
    """Token count and digests of the ids and of the decoded text, a window of the text
    at a time; the ids themselves only go to `ids_out` if that is given."""
    n, ids, decoded, machine, first = 0, hashlib.sha256(), hashlib.sha256(), Utf8(), True
    for part in bpe.windows(text):
        joined, raw = bpe.written(part.tolist())
        n += len(part)
        ids.update((joined if first else "," + joined).encode())
        decoded.update(machine.feed(raw).encode())
        if ids_out is not None:
            ids_out.append(part)
        first = False
    decoded.update(machine.end().encode())
    return n, ids.hexdigest(), decoded.hexdigest()


def encode_columns(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode and decode each text: n_tokens, ids_sha256, decoded_sha256, beside the
    columns in `keep`; with `with_ids` also the ids (``token_ids``).

    `path` is a vocabulary file present on every machine.
    """
    given = docs.select(*keep, F.col("text"))
    added = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    added += [("token_ids", pa.list_(pa.int32()))] if with_ids else []
    sql = {pa.int64(): "long", pa.string(): "string"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name in keep] + [f"{n} {sql.get(t, 'array<int>')}" for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, before, row, ids = load(path), None, None, None
        for batch in batches:
            K.release()
            rows, tokens, held, first = [], [], 0, 0
            for place, value in enumerate(batch.column(len(keep)), 1):
                text = value.as_py() or ""
                if text != before:  # a mix holds the copies of a document next to each other
                    parts = [np.zeros(0, np.int32)]
                    row = _digest(bpe, text, parts if with_ids else None)
                    before, ids = text, np.concatenate(parts) if with_ids else None
                rows.append(row)
                tokens.append(ids)
                held += row[0]
                if held >= HELD or place == len(batch):
                    data = [*map(list, zip(*rows, strict=True)), *([tokens] if with_ids else [])]
                    columns = [batch.column(k).slice(first, len(rows)) for k in range(len(keep))] + [pa.array(x, t) for x, (_, t) in zip(data, added, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, [*keep, *(n for n, _ in added)])
                    rows, tokens, held, first = [], [], 0, place
        K.release()

    return given.mapInArrow(run, schema)
