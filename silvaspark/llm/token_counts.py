"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary is compiled into a deterministic transducer over byte symbols (plain, and word-final). Its
states are (node of the Aho-Corasick automaton over the vocabulary, last token at each suffix of that node), which
is all of a prefix that can influence later merges; each transition is annotated with the change of the token count
that its symbol brings. States and transitions are determinised when first reached and kept.

White space resets the transducer, so the state map of any chunk of text is (symbols before its first reset, tokens
emitted between its resets, symbols after its last). Such maps compose associatively: long texts are cut into
chunks whose maps are composed by a parallel prefix scan.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import filterfalse

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

FINAL = 256  # added to a byte that ends a word
CHUNK = 1 << 16
WORDS_KEPT = 800_000  # of each table of counts that a worker holds; a full one is emptied
STATES_KEPT = 250_000  # likewise of determinised states
PAIRS_KEPT = 400_000  # likewise of pairs of tokens that were tried
ZERO = 2048  # stands for no difference where one of counts is the lower twelve bits of a number


def _byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies -> the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Deterministic token-count transducer of a byte-pair vocabulary with word-final symbols."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str):
        byte = _byte_symbols()

        def symbols(piece: str) -> tuple[int, ...]:
            final = bool(suffix) and piece.endswith(suffix)
            body = [byte[c] for c in (piece[: -len(suffix)] if final else piece)]
            return (*body[:-1], body[-1] + FINAL) if final else tuple(body)

        # tokens are numbered by merge priority: single symbols first, then merges by rank
        names = {(s,): s for s in range(2 * FINAL)}
        self.parts = [(s, s) for s in range(2 * FINAL)]
        self.merged: dict[tuple[int, int], int] = {}
        spelled: list[tuple[int, ...]] = [(s,) for s in range(2 * FINAL)]
        for left, right in merges:
            a, b = names[symbols(left)], names[symbols(right)]
            token = len(self.parts)
            whole = spelled[a] + spelled[b]
            self.merged.setdefault((a, b), token)
            names.setdefault(whole, token)
            self.parts.append((a, b))
            spelled.append(whole)
        self._pairs: dict[int, bool] = {}
        self._automaton([(t, s) for t, s in enumerate(spelled) if names[s] == t and (t < 2 * FINAL or self._stable(*self.parts[t]))])
        if max(self.depth) >= ZERO:
            raise ValueError(f"a token has {max(self.depth)} symbols; counts are kept for fewer than {ZERO}")
        self._restart()

    def _restart(self) -> None:
        # a state: its node; then for each suffix of the node, the empty one first, last token and count less the count here
        self.states = [(0, (-1 << 12) + ZERO)]
        self.ids = {self.states[0]: 0}
        self.moves: dict[int, int] = {}  # state and symbol -> state and count that the symbol brings

    def _stable(self, a: int, b: int) -> bool:
        """Whether the merge (a, b) is reached: nothing inside a + b merges across their border before it."""
        return self._border(a, b, self.merged[a, b])

    def pair_ok(self, a: int, b: int) -> bool:
        """Whether a followed by b is what merging a + b gives."""
        if (ok := self._pairs.get(a << 32 | b)) is None:
            ok = self._pairs[a << 32 | b] = self._border(a, b, len(self.parts))
        return ok

    def _border(self, a: int, b: int, limit: int) -> bool:
        """Walk down the two merge trees at their border, latest merge first: true if no pair there merges earlier."""
        while True:
            token = self.merged.get((a, b))
            if token is not None and token < limit:
                return False
            if a > b:  # a was made after b: until then its right part stood at the border
                limit, a = min(limit, a), self.parts[a][1]
                if limit < 2 * FINAL:
                    return True
            else:
                limit, b = min(limit, b + 1), self.parts[b][0]
                if limit <= 2 * FINAL:
                    return True

    def _automaton(self, words: list[tuple[int, tuple[int, ...]]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.depth, own = [0], {}
        for token, spelled in words:
            node = 0
            for s in spelled:
                if s not in self.next[node]:
                    self.next[node][s] = len(self.next)
                    self.next.append({})
                    self.depth.append(self.depth[node] + 1)
                node = self.next[node][s]
            own[node] = token
        self.fail, queue = [0] * len(self.next), list(self.next[0].values())
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]  # tokens that end here: (length, token)
        self.chain: list[tuple[int, ...]] = [() for _ in self.next]  # lengths of the suffixes that are nodes
        for node in queue:
            for s, child in self.next[node].items():
                self.fail[child] = self._goto(self.fail[node], s)
                queue.append(child)
            mine = [(self.depth[node], own[node])] if node in own else []
            self.ends[node] = mine + self.ends[self.fail[node]]
            self.chain[node] = (self.depth[node], *self.chain[self.fail[node]])

    def _goto(self, node: int, s: int) -> int:
        while node and s not in self.next[node]:
            node = self.fail[node]
        return self.next[node].get(s, 0)

    def _determinise(self, state: int, s: int) -> int:
        key = self.states[state]
        node = key[0]
        known = dict(zip((0, *self.chain[node]), key[1:], strict=True))
        to = self._goto(node, s)
        for length, token in self.ends[to]:
            before = known[length - 1]
            if before < 0 or self.pair_ok(before >> 12, token):
                break
        delta = (before & 4095) - ZERO + 1
        key = (to, (token << 12) + ZERO, *[known[d - 1] - delta for d in self.chain[to]])
        new = self.ids.get(key)
        if new is None:
            new = self.ids[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 9 | s] = found = new << 12 | delta + ZERO
        return found

    def count(self, word: bytes) -> int:
        """Tokens of one word, its last byte word-final."""
        if len(self.states) > STATES_KEPT:  # between words only the start state is needed
            self._restart()
        if len(self._pairs) > PAIRS_KEPT:
            self._pairs.clear()
        state = total = 0
        known = self.moves.get
        for s in (*word[:-1], word[-1] + FINAL):
            move = known(state << 9 | s)
            if move is None:
                move = self._determinise(state, s)
            state = move >> 12
            total += move & 4095
        return total - len(word) * ZERO


SPACE = re.compile(r"[\x1c-\x1f]")  # str.split takes these for white space; the vocabulary's \s does not


class Counter:
    """Counts tokens of texts under a tokenizer file: special strings, normalisation, word pattern, transducer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: a lower-casing BPE vocabulary with word ends is needed")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.transducer = Transducer(merges, model["end_of_word_suffix"])
        self.units: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def unit(self, unit: str) -> int:
        """Tokens of a run without white space."""
        total = 0
        if "<" in unit:
            total = len(self.special.findall(unit))
            if total:
                return total + sum(self.unit(x) for x in self.special.split(unit) if x)
        for word in self.pattern.findall(unicodedata.normalize("NFC", unit).replace("Σ", "σ").lower()):
            n = self.words.get(word)
            if n is None:
                if len(self.words) >= WORDS_KEPT:
                    self.words.clear()
                n = self.transducer.count(word.encode())
                if len(word) < 64:
                    self.words[word] = n
            total += n
        return total

    def chunk(self, text: str) -> tuple[str, int | None, str]:
        """State map of a chunk: (symbols before the first reset, tokens between, symbols after the last reset).

        Without a reset inside, the tokens are None and all symbols stand in front.
        """
        if SPACE.search(text):
            units = regex.split(r"\s+", text)
        else:
            units = text.split()
            if text[:1].isspace():
                units.insert(0, "")
            if text[-1:].isspace():
                units.append("")
        if len(units) < 2:
            return units[0], None, ""
        return units[0], self.total(units[1:-1]), units[-1]

    def total(self, units: list[str]) -> int:
        known = self.units
        if len(known) >= WORDS_KEPT:
            known.clear()
        new = set(filterfalse(known.__contains__, units))
        for u in new:
            known[u] = self.unit(u) if u else 0
        total = sum(map(known.__getitem__, units))
        for u in new:
            if len(u) >= 64:
                del known[u]
        return total

    def compose(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        """The state map of two chunks in a row; associative."""
        if a[1] is None:
            return (a[0] + b[0], *b[1:]) if b[1] is not None else (a[0] + b[0], None, "")
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.total([a[2] + b[0]]) + b[1], b[2]

    def scan(self, maps: list[tuple[str, int | None, str]]) -> list[tuple[str, int | None, str]]:
        """Inclusive prefix scan of chunk maps: pairs are composed, their scan is spread to the odd places."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)])
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]))
        return out

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        maps = [self.chunk(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        head, body, tail = maps[0] if len(maps) == 1 else self.scan(maps)[-1]
        return self.total([head, tail]) + (body or 0)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One compiled counter per Python worker and file."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit`` under the tokenizer file at ``path``.

    ``path`` must be readable on every executor. A null text counts as empty (0 bytes, 0 tokens); texts of any length
    are counted whole; a null doc_id stays null; repeated rows give repeated rows; an empty table gives no rows;
    other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = batch.column(1)
            n_tokens = [c.count(t.as_py() or "") for t in texts]
            n_bytes = [len((t.as_buffer() or b"")) if t.is_valid else 0 for t in texts]
            over = [n > limit for n in n_tokens]
            yield pa.record_batch([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
