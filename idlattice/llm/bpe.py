"""Operator 2: BPE encoding and decoding, speculate and verify.

Greedy longest match proposes the tokens of each new word; all adjacent pairs of
a batch of words are then tested at once against the merge table, and only words
with a pair that the merge order would not have left apart are merged exactly.

Vocabulary format: the JSON of the tokenizers library with a BPE model whose ids
follow the merge order, an end-of-word suffix, byte-level symbols, and the
normaliser NFC + white space + lower case.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from .shared import slices, table

#: Chunks of text whose tokens a worker remembers; beyond it the memory is emptied, which changes no result.
MEMORY = 200_000
NEVER = np.iinfo(np.int64).max
#: The code points with Unicode's White_Space property.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNICODE_SPACE = re.compile(f"[{SPACES}]+")
#: Python takes these for white space, Unicode doesn't.
ODD_SPACES = re.compile("[\x1c-\x1f]")


def character_class(points: list[int]) -> str:
    """The inside of a character class of sorted code points."""
    cuts = [0, *[k for k in range(1, len(points)) if points[k] != points[k - 1] + 1], len(points)]
    return "".join(f"{re.escape(chr(points[a]))}-{re.escape(chr(points[b - 1]))}" for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def all_points() -> list[int]:
    return [k for k in range(sys.maxunicode + 1) if not 0xD800 <= k <= 0xDFFF]


@lru_cache(maxsize=1)
def unassigned() -> str:
    """Code points that Python's Unicode version doesn't assign; planes 4 to 13 have no characters in any."""
    return "".join(c for k in all_points() if not 0x40000 <= k < 0xE0000 and unicodedata.category(c := chr(k)) == "Cn")


def with_category(kind: str) -> list[int]:
    """The code points that the file's patterns take for \\p{kind}.

    The library's Unicode version is newer than Python's, so it is asked for those that Python doesn't assign.
    """
    new = unassigned()
    inside = np.ones(len(new), bool)
    for _, (a, b) in pre_tokenizers.Split(Regex(f"\\p{{{kind}}}+"), "removed").pre_tokenize_str(new):
        inside[a:b] = False
    return sorted([k for k in all_points() if unicodedata.category(chr(k))[0] == kind] + [ord(new[k]) for k in np.flatnonzero(inside).tolist()])


@lru_cache(maxsize=1)
def split_pattern() -> re.Pattern:
    """The file format's split: contractions, letters, single numerals, other runs without white space."""
    letters, numerals = character_class(with_category("L")), character_class(with_category("N"))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numerals}]|[^{SPACES}{letters}{numerals}]+")


@lru_cache(maxsize=1)
def odd_pattern() -> re.Pattern:
    """The code points on which Python's NFC or lower case may differ from the library's, whose normalisation is older.

    Those are marks that it doesn't order and compositions that it doesn't make, with
    their parts, and letters whose lower case Python doesn't know.
    """
    nfc, lower, odd = normalizers.NFC(), normalizers.Lowercase(), set()
    for c in map(chr, all_points()):
        if unicodedata.combining(c):
            odd |= {c} if any(nfc.normalize_str(x) != unicodedata.normalize("NFC", x) for m in "\u0323\u0301\u0334" for x in (f"q{c}{m}", f"q{m}{c}")) else set()
        elif (parts := unicodedata.normalize("NFD", c)) != c and nfc.normalize_str(parts) != unicodedata.normalize("NFC", parts):
            odd |= {c, *parts}
    odd |= {c for c in unassigned() if lower.normalize_str(c) != c}
    return re.compile(f"[{character_class(sorted(map(ord, odd)))}]")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    shifted = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(shifted.get(b, b)) for b in range(256)]


class PairTable:
    """Open-addressing hash table from long keys (0 or more) to long values, for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = keys[left[free]]  # of several for a slot the last stays
            self.values[slot[left[free]]] = values[left[free]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; NEVER where a key is absent."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NEVER)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Bpe:
    """Encoder and decoder for one vocabulary file. A worker keeps one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.odd = odd_pattern()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): self.ids[a + b] for a, b in pairs}
        made = np.array([(a, b, c) for (a, b), c in self.rank.items()], np.int64)
        self.n = len(self.ids)
        if not (made[:, 2] > made[:, :2].max(axis=1)).all() or not (np.diff([self.ids[a + b] for a, b in pairs]) > 0).all():
            raise ValueError("token ids must follow the merge order")
        self.merges = PairTable(made[:, 0] * self.n + made[:, 1], made[:, 2])
        self.longest: dict[str, int] = {}
        for t in self.ids:
            plain = len(t) - len(self.suffix) * (t.endswith(self.suffix) and t != self.suffix)
            self.longest[t[:2]] = max(self.longest.get(t[:2], 1), plain)
        self._spines(made)
        self.own = self._standing_alone()
        self.clear()

    def clear(self) -> None:
        self.memory = {"\n" + t: np.array([i], np.int32).tobytes() for t, i in self.special.items()}

    # -- speculation ------------------------------------------------------
    def greedy(self, word: str) -> list[int]:
        """Longest tokens from the left; the last one ends with the suffix."""
        ids, suffix, longest, out, i, n = self.ids, self.suffix, self.longest, [], 0, len(word)
        while i < n:
            if (t := ids.get(word[i:] + suffix)) is not None:
                out.append(t)
                break
            for j in range(min(n - 1, i + longest.get(word[i : i + 2], 1)), i, -1):
                if (t := ids.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    # -- verification -----------------------------------------------------
    def _spines(self, made: np.ndarray) -> None:
        """right[d][t]: the last token of t, d merges undone; right_until[d][t]: the
        merge that takes it up. left: of the first token."""
        first, last = np.full(self.n, -1), np.full(self.n, -1)
        first[made[:, 2]], last[made[:, 2]] = made[:, 0], made[:, 1]

        def spine(down: np.ndarray) -> tuple[list, list]:
            at, until = [np.arange(self.n)], [np.full(self.n, NEVER)]
            while (at[-1] >= 0).any():
                now = at[-1]
                at.append(np.where(now >= 0, down[now], -1))
                until.append(now)
            return at[:-1], until[:-1]

        self.right, self.right_until = spine(last)
        self.left, self.left_until = spine(first)

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where no merge crosses the border of tokens a and b.

        A token at the border lives from the merge that makes it to the merge that
        takes it up. Merges run in id order, so the border is crossed if two such
        tokens have a merge that comes before either is taken up; at equal rank the
        one further left comes first.
        """
        good = np.ones(len(a), bool)
        for x_all, x_until in zip(self.right, self.right_until, strict=True):
            x, xu = x_all[a], x_until[a]
            if not (x >= 0).any():
                break
            for y_all, y_until in zip(self.left, self.left_until, strict=True):
                y, yu = y_all[b], y_until[b]
                on = np.flatnonzero(good & (x >= 0) & (y >= 0))
                if not len(on):
                    break
                c = self.merges.get(x[on] * self.n + y[on])
                good[on[(c < xu[on]) & (c <= yu[on]) & (c < NEVER)]] = False
        return good

    def _standing_alone(self) -> np.ndarray:
        """Whether exact merging of a token's own symbols gives that token."""
        alone = np.ones(self.n, bool)
        for t, i in self.ids.items():
            word = t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t
            alone[i] = self.exact(word, word != t) == [i]
        return alone

    # -- exact merging ----------------------------------------------------
    def exact(self, word: str, ends: bool = True) -> list[int]:
        """Merges in rank order, leftmost first. ends: the word's last symbol has the suffix."""
        ids, rank = self.ids, self.rank
        parts = [ids[c] for c in word[:-1]] + ([ids[word[-1] + self.suffix if ends else word[-1]]] if word else [])
        if len(parts) > 48:
            return self._exact_long(parts)
        while len(parts) > 1:
            best, at = NEVER, -1
            for k in range(len(parts) - 1):
                if (r := rank.get((parts[k], parts[k + 1]), NEVER)) < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [best]
        return parts

    def _exact_long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(c, k, parts[k], parts[k + 1]) for k in range(n - 1) if (c := rank.get((parts[k], parts[k + 1])))]
        heapq.heapify(heap)
        while heap:
            c, k, a, b = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or j >= n or parts[k] != a or parts[j] != b:
                continue
            parts[k], alive[j], after[k] = c, False, after[j]
            if after[k] < n:
                before[after[k]] = k
            for p, q in ((before[k], k), (k, after[k])):
                if p >= 0 and q < n and (m := rank.get((parts[p], parts[q]))):
                    heapq.heappush(heap, (m, p, parts[p], parts[q]))
        return [p for p, on in zip(parts, alive, strict=True) if on]

    def exact_batch(self, words: list[str]) -> list[list[int]]:
        """exact() of many words at once: a round merges the best pair of each word."""
        out: list[list[int]] = [[]] * len(words)
        ids, suffix = self.ids, self.suffix
        for k in (long := [k for k, w in enumerate(words) if len(w) > 48]):
            out[k] = self.exact(words[k])
        todo = np.array(sorted({*range(len(words))} - {*long}), np.int64)
        if not len(todo):
            return out
        split = [[*[ids[c] for c in w[:-1]], ids[w[-1] + suffix]] for w in (words[k] for k in todo.tolist())]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        parts = np.fromiter(chain.from_iterable(split), np.int64, int(sizes.sum()))
        while len(todo):
            ends = np.cumsum(sizes)
            pair = np.full(len(parts), NEVER)
            inner = np.ones(len(parts), bool)
            inner[ends - 1] = False
            at = np.flatnonzero(inner)
            pair[at] = self.merges.get(parts[at] * self.n + parts[at + 1])
            best = np.minimum.reduceat(pair, ends - sizes)
            done = best == NEVER
            of = np.repeat(np.arange(len(todo)), sizes)
            for k in np.flatnonzero(done).tolist():
                out[todo[k]] = parts[ends[k] - sizes[k] : ends[k]].tolist()
            first = np.flatnonzero((pair == best[of]) & ~done[of])
            first = first[np.concatenate(([True], of[first[1:]] != of[first[:-1]]))] if len(first) else first
            parts[first] = pair[first]
            stay = ~done[of]
            stay[first + 1] = False
            parts, sizes, todo = parts[stay], (sizes - 1)[~done], todo[~done]
        return out

    # -- texts ------------------------------------------------------------
    def words(self, words: list[str]) -> list[list[int]]:
        """Tokens of distinct words in byte symbols."""
        out = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(out)), sizes)
        bad = np.zeros(len(out), bool)
        bad[of[~self.own[flat]]] = True
        inner = np.flatnonzero(of[1:] == of[:-1])
        pairs, back = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
        bad[of[inner[~self.fit(pairs // self.n, pairs % self.n)[back]]]] = True
        failing = np.flatnonzero(bad).tolist()
        for k, tokens in zip(failing, self.exact_batch([words[k] for k in failing]), strict=True):
            out[k] = tokens
        return out

    def learn(self, chunks: list[str]) -> None:
        """Puts chunks (text without white space, normalised) into the memory."""
        symbols, find, split, words = self.symbols, split_pattern().findall, [], {}
        for c in chunks:
            if c.isascii() and c.isalpha():
                own = [c]
            else:
                own = [w if w.isascii() and w.isprintable() else "".join([symbols[b] for b in w.encode()]) for w in find(c)]
            split.append(own)
            for w in own:
                words[w] = b""
        for w, tokens in zip(words, self.words(list(words)), strict=True):
            words[w] = np.array(tokens, np.int32).tobytes()
        for c, own in zip(chunks, split, strict=True):
            self.memory[c] = words[own[0]] if len(own) == 1 else b"".join([words[w] for w in own])

    def pieces(self, text: str) -> list[str]:
        """Normalised chunks without white space; a special token after a line feed."""
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append("\n" + part)
                continue
            if not part.isascii() and self.odd.search(part):
                part = normalizers.Lowercase().normalize_str(normalizers.NFC().normalize_str(part))
            else:
                if not part.isascii() and not unicodedata.is_normalized("NFC", part):
                    part = unicodedata.normalize("NFC", part)
                part = part.replace("Σ", "σ").lower()  # a final sigma is a letter like others here
            out += UNICODE_SPACE.split(part) if ODD_SPACES.search(part) else part.split()
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.memory) > MEMORY:
            self.clear()
        split = [self.pieces(t) for t in texts]
        memory = self.memory
        self.learn([c for c in dict.fromkeys(chain.from_iterable(split)) if c not in memory])
        return [np.frombuffer(b"".join([memory[c] for c in parts]), np.int32) for parts in split]

    def decode(self, ids) -> str:
        """The file names no decoder: the tokens, joined by one space."""
        return " ".join([self.names[i] for i in ids])


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, the token ids of each whole text and, if named, the text
    decoded from those ids. One row per row, repeated rows included; null and empty
    texts have no tokens. One pass without a shuffle; other columns are not read."""
    source = docs.select(*keep, text)
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep] + [f"`{ids}` array<int>"] + ([f"`{decoded}` string"] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        names = np.array([coder.names[i] for i in range(len(coder.names))], object)
        for whole in batches:
            for batch in slices(whole, len(keep)):
                found = coder.encode_batch([t or "" for t in batch.column(len(keep)).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                out = [*batch.columns[: len(keep)], pa.ListArray.from_arrays(offsets, np.concatenate(found) if found else np.empty(0, np.int32))]
                if decoded:
                    out.append(pa.array([" ".join(names[x].tolist()) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [*keep, ids, *([decoded] if decoded else [])])

    return source.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids; null for null ids."""
    fields = [f for f in rows.schema.fields if f.name != text]
    names = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for batch in batches:
            out = [None if x is None else coder.decode(x) for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, text])

    return rows.select(*names).mapInArrow(run, schema)


def op2_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return digests(table(spark, sf_dir, "documents"), path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    from pyspark.sql import functions as F

    coded = encode(docs, path or vocabulary())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
