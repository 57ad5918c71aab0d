"""Exact BPE encoding with word ends: cached words, and tree concatenation of long unsplit text.

The tokenizer file's own library gives the ids of a word the first time it is met. Text between white
space is encoded on its own, which is exact: no word of this pre-tokenizer spans white space. A
word too long for one go is cut in halves down to leaves; at each join growing windows of tokens on
both sides are encoded again until the first and the last token come out unchanged. A sequence of BPE
tokens is the encoding of its text exactly if each neighbouring pair is, so the join is exact.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable
from concurrent.futures import Executor
from functools import cached_property
from typing import Any

from tokenizers import Tokenizer

#: Characters for which this module's word rule equals the library's: no combining marks, no odd spaces, no superscripts or fractions.
_ODD = re.compile("[^\t\n\x0b\x0c\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]")
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: A word of more characters is cut in halves.
LEAF = 4096
#: Entries of a cache's younger half before it becomes the older one; every worker process of an executor has caches of its own.
CACHE = 1 << 16


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Bpe:
    """The merge rules themselves, for parts of words: only the last part has a word end."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.names = {i: s for s, i in self.vocab.items()}
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merged = self.vocab[a + b]
            self.rules.setdefault((self.vocab[a], self.vocab[b]), (rank, merged))

    def base(self, letters: str, last: bool) -> list[int]:
        ids = [self.vocab[c] for c in letters[:-1]]
        return [*ids, self.vocab[letters[-1] + (self.end if last else "")]] if letters else ids

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the rules: lowest rank first, leftmost first."""
        n = len(ids)
        ids, after, before = list(ids), [*range(1, n), -1], [*range(-1, n - 1)]
        alive = [True] * n
        queue = [(*rule, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (rule := self.rules.get((a, b)))]
        queue = [(rank, i, new, a, b) for rank, new, i, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (rule := self.rules.get((ids[x], ids[y]))):
                    heapq.heappush(queue, (rule[0], x, rule[1], ids[x], ids[y]))
        return [t for t, keep in zip(ids, alive, strict=True) if keep]

    def split(self, ids: list[int]) -> list[int]:
        """Tokens back to the base symbols of their text."""
        out: list[int] = []
        for t in ids:
            name = self.names[t]
            if self.end and name.endswith(self.end) and len(name) > len(self.end):
                out += self.base(name[: -len(self.end)], True)
            else:
                out += self.base(name, False)
        return out

    def join(self, left: list[int], right: list[int], window: int = 8) -> list[int]:
        """The encoding of two neighbouring texts of one word, from their own encodings."""
        if not left or not right:
            return left + right
        while True:
            a, b = min(window, len(left)), min(window, len(right))
            seen = self.merge(self.split(left[-a:] + right[:b]))
            if (a == len(left) or seen[0] == left[-a]) and (b == len(right) or seen[-1] == right[b - 1]):
                return left[: len(left) - a] + seen + right[b:]
            window *= 2

    def tree(self, letters: str, last: bool = True, leaf: int = LEAF, pool: Executor | None = None) -> list[int]:
        """Encode a long word: leaves (in ``pool``, if given), then joins of neighbours, level by level."""
        cuts = [(i, min(i + leaf, len(letters))) for i in range(0, len(letters), leaf)]
        one = lambda c: self.merge(self.base(letters[c[0] : c[1]], last and c[1] == len(letters)))
        return self.join_all(list((pool.map if pool else map)(one, cuts)))

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Join encoded leaves of one word, neighbours first, level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


class Recent(dict):
    """What ``make`` gives for a key, kept for the ``size`` keys, or up to twice as many, that were asked for last.

    When the younger half is full it becomes the older one; a key found there moves to the younger half, so frequent keys stay.
    """

    def __init__(self, make: Callable[[str], Any], size: int) -> None:
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str) -> Any:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """Encodes whole texts as the library does; ``form`` says what is kept of the ids of a word, and ``join``, if given, makes one
    of the forms of neighbours."""

    def __init__(self, path: str, form: Callable[[list[int]], Any], join: Callable[[list], Any] | None = None) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.form = form
        self.special_ids = {t.content: i for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items())}
        self.specials = re.compile("|".join(map(re.escape, self.special_ids)) or r"(?!)")
        letters = _byte_letters()
        self.letters = letters
        self.table = {b: letters[b] for b in range(256)}
        model, form_of, big = self.tokenizer.model, form, LEAF

        def word(w: str) -> list[int]:
            mapped = w if w.isascii() else w.encode("utf-8").decode("latin-1").translate(self.table)
            return self.bpe.tree(mapped) if len(mapped) > big else [t.id for t in model.tokenize(mapped)]

        # words beside signs, where forms can't be joined; those that stand alone are cached as chunks
        words = Recent(word, CACHE // 4)

        def chunk(c: str) -> Any:
            if c.isalpha():
                return form_of(word(c))
            parts = [c[:-1], c[-1]] if c[-1] in ",." and c[:-1].isalpha() else _PRETOKEN.findall(c)
            if join is None:
                return form_of([i for w in parts for i in words[w]])
            return join([chunks[w] for w in parts]) if len(parts) > 1 else form_of(word(c))

        # forms that can be joined are small, and signs cost no other cache
        self.chunks = chunks = Recent(chunk, CACHE if join is None else 4 * CACHE)

    @cached_property
    def bpe(self) -> Bpe:
        """The rules, read when the first long word is met: most workers never need them."""
        return Bpe(json.loads(self.tokenizer.to_str()))

    def plain(self, text: str) -> bool:
        """Whether the cached words give exactly what the library gives."""
        return not _ODD.search(text) and "<|" not in text

    def parts(self, text: str) -> list:
        """The formed ids of a whole text, in parts to be joined."""
        if self.plain(text):
            return list(map(self.chunks.__getitem__, text.lower().split()))
        return [self.form(ids) for ids in self.exact(text)]

    def exact(self, text: str) -> list[list[int]]:
        """Any text: special tokens first, then the library on runs between white space, long runs by tree."""
        out, at = [], 0
        for m in [*self.specials.finditer(text), None]:
            out += self._run(text[at : m.start() if m else len(text)])
            if m:
                out.append([self.special_ids[m[0]]])
                at = m.end()
        return out

    def _run(self, text: str) -> list[list[int]]:
        if len(text) <= LEAF:
            return [self.tokenizer.encode(text, add_special_tokens=False).ids] if text else []
        # normalising twice is not the same as once, so the pieces skip that step
        out: list[list[int]] = []
        for piece in self.pieces(self.tokenizer.normalizer.normalize_str(text), LEAF):
            for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece):
                out.append(self.bpe.tree(w) if len(w) > LEAF else [t.id for t in self.tokenizer.model.tokenize(w)])
        return out

    @staticmethod
    def pieces(text: str, size: int) -> list[str]:
        """Cut normalised text at spaces, in pieces of about ``size``; one without a space stays whole."""
        out, at = [], 0
        while at < len(text):
            end = min(at + size, len(text))
            if end < len(text):
                cut = text.rfind(" ", at + 1, end)
                end = cut if cut > 0 else (text.find(" ", end) if " " in text[end:] else len(text))
            out.append(text[at:end])
            at = end
        return out


_encoders: dict[tuple[str, str], WordEncoder] = {}


def encoder(path: str, kind: str, form: Callable[[list[int]], Any], join: Callable[[list], Any] | None = None) -> WordEncoder:
    """One encoder for each worker process, file and form: its caches outlive a task."""
    if (path, kind) not in _encoders:
        _encoders.clear()
        _encoders[path, kind] = WordEncoder(path, form, join)
    return _encoders[path, kind]
