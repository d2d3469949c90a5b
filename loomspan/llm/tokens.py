"""Exact token ids through a bounded cache of pieces.

A text is cut only where no pre-tokenizer rule can reach across, so the ids
of the whole are the ids of its pieces, one after the other. Cuts, hashes of
the pieces and the joining of their ids are array operations over about a
megabyte of text; only new pieces go to the tokenizers library.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Unicode white space beyond ASCII: a run of it may reach across a cut.
RARE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: First bytes of its UTF-8 forms, and second bytes that go with them.
RARE_FIRST, RARE_SECOND = b"\xc2\xe1\xe2\xe3", b"\x85\xa0\x9a\x80\x81"
#: Where it stands, pieces are cut by this, text by text.
WIDE_SPACE = "\x20\x09-\x0d\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WIDE_PIECE = re.compile(f"[{WIDE_SPACE}]*+[^{WIDE_SPACE}]++|[{WIDE_SPACE}]++")
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Pieces that a worker keeps, and their longest; pieces that go to the
#: library at once; bytes of text in one array.
KEPT, LONGEST, AT_ONCE, GROUP = 1_500_000, 64, 2000, 1 << 20


def _classes() -> np.ndarray:
    """For each byte: 1 white space, 2 letters (ASCII or, as UTF-8, \xc0 to
    \xff) and digits, 4 ASCII punctuation but the apostrophe, 8 and 16 what
    may begin and go on a rare space."""
    out = np.zeros(256, dtype=np.uint8)
    out[list(b" \t\n\x0b\x0c\r")] |= 1
    out[[*range(48, 58), *range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] |= 2
    out[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] |= 4
    out[list(RARE_FIRST)] |= 8
    out[list(RARE_SECOND)] |= 16
    return out


CLASSES = _classes()
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Words of Latin letters: one pre-token each, so those rules can be skipped.
PLAIN = {True: re.compile("\x20?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+"), False: re.compile("[a-z\xdf-\xf6\xf8-\xff]+")}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in own else next(others)) for b in range(256)}


class Codec:
    """A tokenizer, and a separator that it can't miss: pieces go to the
    library as one text with a special string between them, which ends every
    pre-token and has an id of its own, so ids part where it stands."""

    def __init__(self, path: str, bare: bool) -> None:
        self.path, self.bare, self._single = path, bare, None
        self.joined = self._load()
        added = self.joined.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        mark = next((i for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)), None)
        self.mark, self.separator = mark, None if mark is None else added[mark].content

    def _load(self):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        out = Tokenizer.from_file(self.path)
        if self.bare:
            out.pre_tokenizer, out.normalizer = pre_tokenizers.Sequence([]), normalizers.Sequence([])
        return out

    @property
    def single(self):
        """The tokenizer that takes special strings as ordinary text."""
        if self._single is None:
            self._single = self._load()
            self._single.encode_special_tokens = True
        return self._single

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, special strings as ordinary text."""
        whole = "\n".join(texts)
        if self.separator is None or any(x in whole for x in self.special):
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.single.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[bytes] = []
        joined = [self.separator.join([*texts[i : i + AT_ONCE], ""]) for i in range(0, len(texts), AT_ONCE)]
        for found in self.joined.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(found.ids, dtype="<u4")
            raw, ends = ids.tobytes(), 4 * np.flatnonzero(ids == self.mark)
            starts = np.concatenate(([0], ends[:-1] + 4))
            out += [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return out


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, special strings as
    ordinary text. ``spaced``: white space belongs to the ids (byte-level
    vocabularies); otherwise the vocabulary drops it.

    ``plain`` is the same tokenizer without its normalizer and pre-tokenizer,
    for words that these leave whole. Pieces are known by a 64-bit hash, a sum
    of random numbers by byte and place; longer ones than ``LONGEST`` bytes are
    not kept."""

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full, self.plain = Codec(path, bare=False), Codec(path, bare=True)
        self.letters = _byte_letters()
        self.spaced = spaced
        self.random = np.random.default_rng(29).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.powers, self.inverses = _powers(FACTOR, GROUP + 4096), _powers(INVERSE, GROUP + 4096)
        self._forget()

    def _forget(self) -> None:
        #: Hashes of the pieces in order, and the entry of each.
        self.names, self.entries = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.starts, self.sizes, self.again = (np.zeros(1 << 12, dtype=k) for k in (np.int64, np.int64, bool))
        self.ids, self.held, self.filled = np.zeros(1 << 14, dtype="<u4"), 0, 0
        self.wide: dict[str, bytes] = {}

    def _forget_some(self) -> None:
        """Keeps the pieces that were met in a later group than their first."""
        stay = self.again[self.entries]
        names, entries = self.names[stay], self.entries[stay]
        sizes, ids = self.sizes[entries], self._gather(entries)
        self._forget()
        if len(names) <= KEPT // 2:
            self.names, self.entries = names, self._put(sizes, ids)

    def _gather(self, entries: np.ndarray) -> np.ndarray:
        """The ids of the entries, one after the other."""
        sizes = self.sizes[entries]
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[entries] - ends + sizes, sizes)]

    def _put(self, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """New entries; returns their numbers."""
        first, past = self.held, self.held + len(sizes)
        for name, used, more in (("starts", first, len(sizes)), ("sizes", first, len(sizes)), ("again", first, len(sizes)), ("ids", self.filled, len(ids))):
            old = getattr(self, name)
            if used + more > len(old):
                setattr(self, name, np.concatenate((old, np.zeros(max(len(old), used + more), dtype=old.dtype))))
        self.starts[first:past] = self.filled + np.cumsum(sizes) - sizes
        self.sizes[first:past], self.again[first:past] = sizes, False
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.held, self.filled = past, self.filled + len(ids)
        return np.arange(first, past)

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        found = self._library(pieces)
        return self._put(np.array([len(f) // 4 for f in found], dtype=np.int64), np.frombuffer(b"".join(found), dtype="<u4"))

    def _library(self, pieces: list[bytes]) -> list[bytes]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        simple = PLAIN[self.spaced].fullmatch
        easy = [i for i, t in enumerate(texts) if simple(t)]
        hard = [i for i, t in enumerate(texts) if not simple(t)]
        out = [b""] * len(pieces)
        space = self.letters[32]
        mapped = [texts[i].replace(" ", space) if pieces[i].isascii() else pieces[i].decode("latin-1").translate(self.letters) for i in easy]
        for own, codec, given in ((easy, self.plain, mapped), (hard, self.full, [texts[i] for i in hard])):
            for i, found in zip(own, codec.ids(given) if given else [], strict=True):
                out[i] = found
        return out

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last places of the pieces; ``bounds`` are the first
        places of the texts. A piece is white space and a word; a word that
        begins with letters ends before punctuation, since every rule ends
        there, so that words recur more."""
        n, kind = len(data), CLASSES[data]
        space, edge = (kind & 1).astype(bool), np.zeros(n, dtype=bool)
        edge[bounds] = True
        after = np.empty(n, dtype=bool)
        after[0], after[1:] = True, space[:-1]
        words = np.flatnonzero(~space & (after | edge))
        stops = np.flatnonzero(space | edge)
        past = np.append(stops, n)[np.searchsorted(stops, words, side="right")]
        others = np.flatnonzero(kind & 2 == 0)
        at = np.append(others, n)[np.searchsorted(others, words)]
        cut = at[(at > words) & (at < past)]
        cut = cut[kind[cut] & 4 > 0]
        first = edge | space & ~after if self.spaced else np.zeros(n, dtype=bool)
        first[cut] = True
        if self.spaced:  # the last of a run goes apart, and but for a blank no rule joins it to the word
            led = words[~edge[words]]
            first[led - 1] = True
            first[led[data[led - 1] != 32]] = True
        else:
            first[words] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        if not self.spaced:
            ends = np.minimum(ends, np.append(stops, n)[np.searchsorted(stops, starts, side="right")])
        return starts, ends

    def _group(self, texts: list[bytes]) -> list[bytes]:
        """The ids of some texts, none empty or with rare white space."""
        data = b"".join(texts)
        values = np.frombuffer(data, dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        bounds, n = np.cumsum(sizes) - sizes, len(data)
        starts, ends = self._cut(values, bounds)
        powers, inverses = (self.powers, self.inverses) if n <= len(self.powers) else (_powers(FACTOR, n), _powers(INVERSE, n))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.random[values] * powers[:n], out=sums[1:])
        lengths = ends - starts
        names = (sums[ends] - sums[starts]) * inverses[starts] + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        if len(self.names) > KEPT:
            self._forget_some()
        distinct, one, of = np.unique(names, return_index=True, return_inverse=True)
        place = np.searchsorted(self.names, distinct)
        known = np.append(self.names, np.uint64(0))[place] == distinct
        known[place == len(self.names)] = False
        entry = np.empty(len(distinct), dtype=np.int64)
        entry[known] = self.entries[place[known]]
        self.again[entry[known]] = True
        piece = lambda i: data[starts[i] : ends[i]]
        fresh = np.flatnonzero(~known & (lengths[one] <= LONGEST))
        entry[fresh] = self._add([piece(i) for i in one[fresh].tolist()])
        self.names, self.entries = np.insert(self.names, place[fresh], distinct[fresh]), np.insert(self.entries, place[fresh], entry[fresh])
        lasting, entry = (self.held, self.filled), entry[of]
        places = np.flatnonzero(lengths > LONGEST)
        if len(places):  # told apart by their bytes, and not kept
            longs = [piece(i) for i in places.tolist()]
            once = list(dict.fromkeys(longs))
            number = dict(zip(once, self._add(once).tolist(), strict=True))
            entry[places] = [number[x] for x in longs]
        total = np.concatenate(([0], np.cumsum(self.sizes[entry])))
        out = self._gather(entry).tobytes()
        self.held, self.filled = lasting
        at = 4 * np.append(total[np.searchsorted(starts, bounds)], total[-1])
        return [out[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _wide(self, text: bytes) -> bytes:
        """The ids of a text with white space beyond ASCII."""
        pieces = WIDE_PIECE.findall(text.decode("utf-8", "replace"))
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.wide]
        if len(self.wide) > KEPT // 8:
            self.wide, fresh = {}, list(dict.fromkeys(pieces))
        self.wide.update(zip(fresh, self.full.ids(fresh) if fresh else [], strict=True))
        out = b"".join(map(self.wide.__getitem__, pieces))
        for p in fresh:
            if len(p) > LONGEST:
                del self.wide[p]
        return out

    def _rare(self, text: bytes) -> bool:
        """Whether there may be white space beyond ASCII; few texts have both bytes."""
        if text.isascii():
            return False
        kind = CLASSES[np.frombuffer(text, dtype=np.uint8)]
        return bool((kind[:-1] >> 3 & kind[1:] >> 4 & 1).any()) and RARE_SPACE.search(text.decode("utf-8", "replace")) is not None

    def _parts(self, text: bytes) -> list[bytes]:
        """A long text, cut where a run of white space begins."""
        out, first = [], 0
        while len(text) - first > GROUP:
            at = text.rfind(b" ", first + 1, first + GROUP)
            while at > first and text[at - 1] in b" \t\n\x0b\x0c\r":
                at -= 1
            if at <= first:
                break
            out.append(text[first:at])
            first = at
        return [*out, text[first:]]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text, null as empty, without an end id."""
        found: dict[bytes | None, list[bytes]] = {t: [] for t in set(texts)}
        waiting: list[bytes] = []
        owners: list[bytes] = []
        held = 0

        def flush() -> None:
            nonlocal held
            for owner, ids in zip(owners, self._group(waiting) if waiting else [], strict=True):
                found[owner].append(ids)
            waiting.clear()
            owners.clear()
            held = 0

        for text in found:
            if not text:
                continue
            if self.spaced and self._rare(text):
                found[text].append(self._wide(text))
                continue
            for part in self._parts(text if self.spaced else text.translate(FOLD)):
                if held and held + len(part) > GROUP:
                    flush()
                waiting.append(part)
                owners.append(text)
                held += len(part)
        flush()
        whole = {t: parts[0] if len(parts) == 1 else b"".join(parts) for t, parts in found.items()}
        return [whole[t] for t in texts]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]
