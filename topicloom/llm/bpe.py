"""BPE encoding and decoding: speculate, verify, and merge exactly only where that fails.

Texts are cut at ASCII white space; each different piece of a batch is normalised and split
into words by the tokenizer's own normaliser and pre-tokeniser, and each new word is encoded
once. Greedy longest-match proposes the tokens of all new words; one vectorised pass tests
every adjacent pair of proposed tokens, by undoing the merges on both sides of the boundary
from the latest to the first and looking for a merge across it that would have come earlier.
Words in which a pair fails, and single tokens that merging does not reach, are merged exactly.
Decoding joins the vocabulary strings of the ids by a space, as a tokenizer without decoder.

Cases: a null text encodes like an empty one, to no ids; texts of any length are encoded
whole, in linear memory; special tokens in a text are single ids; repeated and equal rows are
each returned; an empty table gives no rows; extra columns pass by.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from topicloom.llm.common import slices, small_batches

END = "</w>"
#: Pieces and words that a task remembers in each of two generations, bytes of the longest.
MEMORY, PIECE = 40_000, 256
#: Bytes of text that are encoded together.
TOGETHER = 3 << 20
#: Symbols up to which words are proposed and merged together, in arrays.
SHORT = 32
#: Words of lower-case printable ASCII: the tokenizer's split without its Unicode classes.
#: Fixed values, as in the tokenizer's definition.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class Table:
    """Whole numbers to whole numbers, looked up for arrays; -1 where a key is absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            # One key for each free slot; the others try the next one.
            slots, first = np.unique(at, return_index=True)
            first = first[self.keys[slots] < 0]
            self.keys[at[first]], self.values[at[first]] = keys[todo[first]], values[todo[first]]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.values[at], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == keys[todo]
            found[todo[hit]] = self.values[at[hit]]
            on = ~hit & (held >= 0)
            todo, at = todo[on], at[on]
        return found


class Encoder:
    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.definition = definition
        self.tokenizer = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(self.names) + 1
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.size = size
        #: Rank of the merge of two ids, under one number for both; and what a rank makes.
        self.pair: dict[int, int] = {}
        self.made: list[int] = []
        for r, (a, b) in enumerate(merges):
            x, y, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.pair[x * size + y] = r
            self.made.append(made)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = r, x, y
        self.ranks = Table(np.array(list(self.pair), np.int64), np.array(list(self.pair.values()), np.int64))
        self.makes = np.array(self.made, np.int64)
        self._grow()
        self.id_text = {i: str(i) for i in self.names}
        #: Longest vocabulary entry by its first two characters.
        self.reach: dict[str, int] = {}
        for s in self.vocab:
            self.reach[s[:2]] = max(self.reach.get(s[:2], 1), len(s.removesuffix(END)))
        self.reached = np.array([
            self.merge(self.names[i]) == [i] if i in self.names and self.names[i] in self.vocab else False
            for i in range(size)
        ])
        #: Whether ASCII_WORD states this tokenizer's split.
        splits = spec["pre_tokenizer"]["pretokenizers"]
        self.plain = splits[0]["pattern"].get("Regex") == SPLIT
        #: What is remembered now, and the generation before, whose hits move over.
        self.pieces: dict[bytes, tuple[bytes, int, bytes]]
        self.words: dict[str | int, tuple[bytes, int, bytes]]
        self.old_pieces: dict[bytes, tuple[bytes, int, bytes]]
        self.old_words: dict[str | int, tuple[bytes, int, bytes]]
        self.forget()
        self.firsts = {s[0] for s in self.special}
        self.failed = self.seen = 0

    def _grow(self) -> None:
        """The vocabulary as a tree of characters: steps from node to node, and the entry that
        ends at each node, within a word and at its end."""
        steps: dict[int, int] = {}
        inner, last = [-1], [-1]
        for s, i in self.vocab.items():
            bare, node = s.removesuffix(END), 0
            for c in bare:
                key = node << 21 | ord(c)
                node = steps.setdefault(key, len(inner))
                if node == len(inner):
                    inner.append(-1)
                    last.append(-1)
            if bare:
                (last if bare != s else inner)[node] = i
        self.steps = Table(np.array(list(steps), np.int64), np.array(list(steps.values()), np.int64))
        self.inner, self.last = np.array(inner), np.array(last)

    def forget(self) -> None:
        """Drop what is remembered of pieces and words."""
        self.pieces, self.words, self.old_pieces, self.old_words = {}, {}, {}, {}

    def symbols(self, word: str) -> list[str]:
        """Characters of a word, the last with the mark of a word's end."""
        bare = word.removesuffix(END)
        marked = word != bare
        return [*bare[:-1], bare[-1] + END] if marked and bare else list(bare)

    def merge(self, word: str) -> list[int]:
        """Exact merging of a marked word: always the first merge of lowest rank."""
        ids = [self.vocab[s] for s in self.symbols(word)]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        pair, size, never = self.pair, self.size, len(self.made)
        ranks = [pair.get(x * size + y, never) for x, y in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < never:
            i = ranks.index(low)
            ids[i : i + 2] = [self.made[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = pair.get(ids[i - 1] * size + ids[i], never)
            if i < len(ranks):
                ranks[i] = pair.get(ids[i] * size + ids[i + 1], never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of candidate merges, for words of any length."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (key := ids[i] * self.size + ids[j]) in self.pair:
                heapq.heappush(heap, (self.pair[key], i, key))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, key = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ids[i] * self.size + ids[j] != key:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in ids if t >= 0]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match on a marked word."""
        vocab, reach, bare, found, i = self.vocab, self.reach, word[: -len(END)], [], 0
        n = len(bare)
        while i < n:
            end = min(n, i + reach.get(bare[i : i + 2], 1))
            if end == n:
                t = vocab.get(word[i:])
                if t is not None:
                    found.append(t)
                    break
                end -= 1
            for j in range(end, i, -1):
                t = vocab.get(bare[i:j])
                if t is not None:
                    found.append(t)
                    i = j
                    break
            else:
                raise ValueError(f"no vocabulary entry begins {word[i:]!r}")
        return found

    def propose_all(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match on many words at once: the number of each token's word, and the
        token. ``codes`` are the words' characters without marks, ``ends`` their bounds."""
        word = np.arange(len(ends) - 1)
        at, stop = ends[:-1].copy(), ends[1:]
        node = np.zeros(len(word), np.int64)
        best, best_at = np.full(len(word), -1), at.copy()
        words, tokens = [], []
        while len(word):
            node = self.steps.find(node << 21 | codes[at])
            on = node >= 0
            at = at + on
            over = at == stop[word]
            entry = np.where(over, self.last[node], self.inner[node])
            met = on & (entry >= 0)
            best, best_at = np.where(met, entry, best), np.where(met, at, best_at)
            done = ~on | over
            if done.any():
                if (best[done] < 0).any():
                    raise ValueError("no vocabulary entry begins a word")
                words.append(word[done])
                tokens.append(best[done])
                at = np.where(done, best_at, at)
                node[done], best[done] = 0, -1
                more = at < stop[word]
                word, at, node, best, best_at = word[more], at[more], node[more], best[more], best_at[more]
        words, tokens = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def merge_all(self, codes: np.ndarray) -> list[list[int]]:
        """Exact merging of words of one length, one per row; as ``merge`` does it."""
        never = len(self.made)
        first = self.steps.find(codes)
        ids = np.where(np.arange(codes.shape[1]) == codes.shape[1] - 1, self.last[first], self.inner[first])
        if (first < 0).any() or (ids < 0).any():
            raise ValueError("a character without a vocabulary entry")

        def rank(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            found = self.ranks.find(x * self.size + y)
            return np.where(found < 0, never, found)

        out: list[list[int]] = [[]] * len(ids)
        row, ranks = np.arange(len(ids)), rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(row):
            if not ranks.shape[1]:
                low = np.full(len(row), never)
            else:
                at = ranks.argmin(1)
                low = ranks[np.arange(len(row)), at]
            still = low < never
            for i, found in zip(row[~still].tolist(), ids[~still].tolist()):
                out[i] = found
            row, ids, ranks = row[still], ids[still], ranks[still]
            if not len(row):
                break
            at, low, every = at[still], low[still], np.arange(len(row))
            ids[every, at] = self.makes[low]
            width = ids.shape[1]
            ids = ids[np.arange(width) != (at + 1)[:, None]].reshape(len(row), width - 1)
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(len(row), width - 2)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = rank(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < width - 2)
            ranks[right, at[right]] = rank(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the strings of a and b leaves the boundary between them."""
        never = np.iinfo(np.int64).max
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        up_a, up_b = np.full(len(a), never), np.full(len(a), never)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self.ranks.find(x * self.size + y)
            across = np.where(across < 0, never, across)
            # Of equal ranks the one further left comes first.
            bad = (across < up_a[live]) & (across <= up_b[live]) & (across < never)
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            live = live[~bad & ((rx >= 0) | (ry >= 0))]
            rx, ry = self.rank[a[live]], self.rank[b[live]]
            undo_b = ry >= rx
            p, q = live[undo_b], live[~undo_b]
            up_b[p], b[p] = ry[undo_b], self.left[b[p]]
            up_a[q], a[q] = rx[~undo_b], self.right[a[q]]
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words: proposed, verified together, merged where that fails."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words)) - len(END)
        short = np.flatnonzero((lengths > 0) & (lengths <= SHORT))
        long = np.flatnonzero((lengths <= 0) | (lengths > SHORT)).tolist()
        bare = "".join([words[i][: -len(END)] for i in short.tolist()])
        codes = np.frombuffer(bare.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths[short])])
        word, flat = self.propose_all(codes, ends) if len(short) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        apart = [self.propose(words[i]) for i in long]
        owner = np.concatenate([short[word], np.repeat(long, [len(p) for p in apart])]).astype(np.int64)
        flat = np.concatenate([flat, np.array([t for p in apart for t in p], np.int64)])
        wrong = np.zeros(len(words), bool)
        wrong[owner[~self.reached[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        fits = self.compatible(flat[inside], flat[inside + 1])
        wrong[owner[inside[~fits]]] = True
        # The tokens of a word stand together.
        many = np.bincount(owner, minlength=len(words))
        first = np.zeros(len(words), np.int64)
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        first[owner[heads]] = heads
        tokens = flat.tolist()
        found = [tokens[a : a + n] for a, n in zip(first.tolist(), many.tolist())]
        for i in long:
            if wrong[i]:
                found[i] = self.merge(words[i])
        again = np.flatnonzero(wrong[short])
        for n in np.unique(lengths[short[again]]).tolist():
            same = again[lengths[short[again]] == n]
            merged = self.merge_all(codes[ends[same][:, None] + np.arange(n)])
            for i, ids in zip(short[same].tolist(), merged):
                found[i] = ids
        self.failed += int(wrong.sum())
        self.seen += len(words)
        return found

    def text(self, ids: list[int]) -> tuple[bytes, int, bytes]:
        """Ids as text, their number, and what they decode to."""
        names, texts = self.names, self.id_text
        return " ".join([texts[t] for t in ids]).encode(), len(ids), " ".join([names[t] for t in ids]).encode()

    def split(self, text: str) -> list[str | int]:
        """Marked words and the ids of special tokens of a piece, in order."""
        found: list[str | int] = []
        special = self.cut is not None and any(c in text for c in self.firsts)
        for bit in self.cut.split(text) if special else (text,):
            if special and bit in self.special:
                found.append(self.special[bit])
            elif self.plain and bit.isascii() and bit.isprintable():
                found += [w + END for w in ASCII_WORD.findall(bit.lower())]
            elif bit:
                normal = self.tokenizer.normalizer.normalize_str(bit)
                found += [w + END for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return found

    def learn(self, pieces: list[bytes]) -> None:
        """Encode pieces without white space, each as ``text`` gives it."""
        parts = [self.split(p.decode()) for p in pieces]
        words, old = self.words, self.old_words
        new = {w for found in parts for w in found if w not in words}
        kept = [w for w in new if w in old]
        words.update((w, old[w]) for w in kept)
        new = list(new.difference(kept))
        marked = [w for w in new if isinstance(w, str)]
        words.update(zip(marked, map(self.text, self.encode_words(marked))))
        words.update((w, self.text([w])) for w in new if not isinstance(w, str))
        held = self.pieces
        for piece, found in zip(pieces, parts):
            if len(found) == 1:
                held[piece] = words[found[0]]
            else:
                bits = [words[w] for w in found]
                held[piece] = (
                    b" ".join([x[0] for x in bits]), sum([x[1] for x in bits]), b" ".join([x[2] for x in bits])
                )

    def rows(self, texts: list[bytes]) -> Iterator[tuple[bytes, int, bytes]]:
        """For each text its ids as text, their number, and the decoded text."""
        split = [t.split() for t in texts]
        used = set().union(*split)
        if len(self.pieces) > MEMORY:
            self.old_pieces, self.pieces = self.pieces, {}
        if len(self.words) > MEMORY:
            self.old_words, self.words = self.words, {}
        held, old = self.pieces, self.old_pieces
        new = [p for p in used if p not in held]
        kept = [p for p in new if p in old]
        held.update((p, old[p]) for p in kept)
        self.learn(list(set(new).difference(kept)))
        for words in split:
            found = [f for f in map(held.__getitem__, words) if f[1]]
            yield b" ".join([f[0] for f in found]), sum([f[1] for f in found]), b" ".join([f[2] for f in found])
        # Very long pieces are seldom met again.
        for piece in [p for p in used if len(p) > PIECE]:
            del held[piece]
        for word in [w for w in self.words if isinstance(w, str) and len(w) > PIECE]:
            del self.words[word]


_ENCODERS: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One encoder for a definition in each Python worker."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def _run(docs: DataFrame, path: str | None, schema: str, row) -> DataFrame:
    """``row`` turns (ids as text, number, decoded) into the cells that follow the id."""
    with open(path or default_path(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    types = docs.select("doc_id").schema
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        gc.set_threshold(200_000, 50, 50)  # many small objects, no cycles
        for batch in batches:
            for part in slices(batch, 1, TOGETHER):
                texts = part.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
                cells = list(zip(*(row(*r) for r in coder.rows(texts))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c) for c in cells]],
                    names=["doc_id", *[f"c{i}" for i in range(len(cells))]],
                )
            pa.default_memory_pool().release_unused()
        # The worker may serve other tasks next.
        coder.forget()

    kind = types["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, token_ids, decoded: the ids of every text and what they decode to."""
    def cells(ids: bytes, _: int, decoded: bytes):
        return np.array(ids.split(), np.int32), decoded.decode()

    out = _run(docs, path, "c0 array<int>, c1 string", cells)
    return out.select("doc_id", F.col("c0").alias("token_ids"), F.col("c1").alias("decoded"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the same encoding and decoding."""
    def cells(ids: bytes, n: int, decoded: bytes):
        return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    out = _run(docs, path, "c0 long, c1 string, c2 string", cells)
    return out.select(
        "doc_id", F.col("c0").alias("n_tokens"), F.col("c1").alias("ids_sha256"),
        F.col("c2").alias("decoded_sha256"),
    )
