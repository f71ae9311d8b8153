"""Token counts by a compiled finite-state tokenizer.

Byte-pair merging of a text is decided from left to right: of the tokens that end at a
place, exactly one is such that merging it together with the token before it gives those
two again. So a prefix's last token and number of tokens follow from those of shorter
prefixes, as far back as a piece of the vocabulary may still be open. What is open (the
place in a trie of all pieces, the token before it, tokens since) is a state of a
deterministic transducer over characters; its transitions carry the change in the number
of tokens, which may be negative where merges close up. States are compiled from the
pieces and their scores when first met; the library is not asked for any text. When the
tables are full, states that are not in use are dropped, which changes no result.

A text is cut into chunks that are all read at once, one lane to a chunk. A chunk is a
map of states to states with a number of tokens; it is worked out for the state that the
characters before it suggest and for every state that another chunk's map leads to.
Maps compose, and a parallel prefix scan over a text's chunks does it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

MODEL = "piece_bpe_32k.model"
OVER = 4096
#: Characters of a lane, characters before it that suggest its first state, bytes of texts in a group, and transitions after which unused states are dropped.
CHUNK = 512
AHEAD = 32
BATCH = 2 << 20
LIMIT = 1 << 21
#: Pairs of tokens whose verdict is kept.
PAIRS = 1 << 18
MARK = "▁"
FREE = np.int64(-1)


class Transducer:
    """Lazily determinised automaton of one sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str, limit: int = LIMIT):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        letters = sorted(set("".join(self.score)))
        #: Symbols: 1 to 4 for a character of no piece with so many bytes, then the characters of pieces; a space is a mark.
        self.symbol = np.ones(0x110000, np.int32)
        self.symbol[0x80:], self.symbol[0x800:], self.symbol[0x10000:] = 2, 3, 4
        self.letters = ["", "", "", "", "", *letters]
        self.symbol[[ord(c) for c in letters]] = np.arange(5, len(self.letters))
        self.symbol[ord(" ")] = self.symbol[ord(MARK)]
        self.bits = len(self.letters).bit_length()
        # A character that is no piece by itself is spelled in bytes unless it is merged.
        self.cost = {c: 1 if c in self.score else len(c.encode()) for c in letters}
        self.touching = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.children: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for p in [*self.score, *letters]:
            at = 0
            for c in p:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                at = self.children[at][c]
            self.token[at] = p
        self.limit, self.pairs = limit, {}
        self.reset([((0, None, 0),)])

    def reset(self, states: list[tuple]) -> None:
        """No transitions, and these states; the first is a text's start."""
        size = 1 << self.limit.bit_length()
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1
        self.key, self.to, self.emit = np.full(size, FREE), np.zeros(size, np.int32), np.zeros(size, np.int16)
        self.states = list(states)
        self.number = {s: i for i, s in enumerate(self.states)}
        self.used = 0

    def keep(self, states: np.ndarray) -> np.ndarray:
        """Drops all but the first and these states where the table is half full; their new numbers."""
        if self.used <= self.limit // 2:
            return states
        held, at = np.unique(np.concatenate(([0], states)), return_inverse=True)
        self.reset([self.states[i] for i in held.tolist()])
        return at[1:].astype(np.int32)

    def apart(self, a: str, b: str) -> bool:
        """Whether merging two tokens' characters gives these two tokens."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def merged(self, text: str) -> list[str]:
        """Pieces by merging the neighbours of the highest score, the leftmost first, until none is left."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def transition(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and the change in tokens."""
        if symbol < 5:
            return 0, symbol  # no piece goes on over it, so all is as at a text's start
        c, last, change, open_ = self.letters[symbol], None, None, []
        for node, before, since in self.states[state]:
            if node == 0 and before is not None and before[-1] + c not in self.touching:
                before = None  # no piece can go over this border
            child = self.children[node].get(c)
            if child is None:
                continue
            token = self.token[child]
            if change is None and token is not None and (before is None or self.apart(before, token)) and (len(token) == 1 or self.merged(token) == [token]):
                last, change = token, self.cost.get(token, 1) - since
            if self.children[child]:
                open_.append((child, before, since))
        new = (*((n, b, s + change) for n, b, s in open_), (0, last, 0))
        found = self.number.get(new)
        if found is None:
            found = self.number[new] = len(self.states)
            self.states.append(new)
        return found, change

    def slots(self, key: np.ndarray) -> np.ndarray:
        """Each key's slot, or the free one where it would be."""
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        held = self.key[at]
        rest = np.flatnonzero((held != key) & (held != FREE))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            held = self.key[at[rest]]
            rest = rest[(held != key[rest]) & (held != FREE)]
        return at

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the changes in tokens; transitions that are not in the table yet are compiled."""
        key = (state.astype(np.int64) << self.bits) | symbol
        at = self.slots(key)
        new = np.flatnonzero(self.key[at] == FREE)
        if len(new):
            for k in np.unique(key[new]).tolist():
                own = np.array([k])
                slot = int(self.slots(own)[0])
                self.to[slot], self.emit[slot] = self.transition(k >> self.bits, k & ((1 << self.bits) - 1))
                self.key[slot] = k
                self.used += 1
            at[new] = self.slots(key[new])
        return self.to[at], self.emit[at]

    def read(self, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Reads lanes of symbols at once from a state each: their last states and tokens, and the states given as they are numbered now."""
        slab = max(1, self.limit // (2 * CHUNK))  # each symbol may need a transition: half the table at most
        ends, tokens = np.zeros(len(begins), np.int32), np.zeros(len(begins), np.int64)
        for i in range(0, len(begins), slab):
            both = self.keep(np.concatenate((states, ends[:i])))
            states, ends[:i] = both[: len(states)], both[len(states) :]
            part = np.arange(i, min(i + slab, len(begins)))
            part = part[np.argsort(-sizes[part], kind="stable")]  # the longest first: lanes that end leave at the back
            at, n, state, told = begins[part], sizes[part], states[part], np.zeros(len(part), np.int64)
            width = len(part)
            for t in range(int(n[0])):
                while n[width - 1] <= t:
                    width -= 1
                state[:width], change = self.step(state[:width], symbols[at[:width] + t])
                told[:width] += change
            ends[part], tokens[part] = state, told
        return ends, tokens, states


def count_texts(machine: Transducer, texts: list[str], chunk: int = CHUNK, ahead: int = AHEAD) -> list[int]:
    """Tokens of each text, as the library counts them without begin, end or other special tokens."""
    out = np.zeros(len(texts), np.int64)
    origin = np.array([i for i, t in enumerate(texts) if t], np.int64)
    if not len(origin):
        return out.tolist()
    # The library puts a mark in front of what is not empty.
    symbols = machine.symbol[np.frombuffer("".join(" " + texts[i] for i in origin).encode("utf-32-le"), np.uint32)]
    sizes = np.array([len(texts[i]) + 1 for i in origin], np.int64)
    starts, each = np.cumsum(sizes) - sizes, -(-sizes // chunk)
    of = np.repeat(np.arange(len(origin)), each)
    place = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    begins = starts[of] + place * chunk
    lengths = np.minimum(chunk, (starts + sizes)[of] - begins)
    before = np.where(place > 0, min(ahead, chunk), 0)
    machine.keep(np.zeros(0, np.int32))
    first = machine.read(symbols, begins - before, before, np.zeros(len(of), np.int32))[0]
    lane, state = np.arange(len(of)), first
    end, tokens, state = machine.read(symbols, begins, lengths, state)
    last = np.concatenate((of[1:] != of[:-1], [True]))
    # Until every state that a map leads to is one of the next chunk's.
    while True:
        key = lane.astype(np.int64) << 32 | state
        goes = ~last[lane]
        need = np.unique((lane[goes] + 1).astype(np.int64) << 32 | end[goes])
        need = need[~np.isin(need, key)]
        if not len(need):
            break
        more = need >> 32
        both = np.concatenate((need & 0xFFFFFFFF, state, end)).astype(np.int32)
        got, told, both = machine.read(symbols, np.concatenate((begins[more], np.zeros(2 * len(lane), np.int64))), np.concatenate((lengths[more], np.zeros(2 * len(lane), np.int64))), both)
        n, m = len(more), len(lane)
        lane, state, end, tokens = np.concatenate((lane, more)), np.concatenate((both[n : n + m], both[:n])), np.concatenate((both[n + m :], got[:n])), np.concatenate((tokens, told[:n]))
    order = np.argsort(key)
    lane, end, tokens, key = lane[order], end[order], tokens[order], key[order]
    # The scan: in each round a map is composed with that of as many chunks after it.
    to = np.where(last[lane], len(lane), np.searchsorted(key, (lane + 1).astype(np.int64) << 32 | end))
    to, tokens = np.append(to, len(lane)), np.append(tokens, 0)
    for _ in range(int(each.max()).bit_length()):
        tokens = tokens + tokens[to]
        to = to[to]
    heads = np.cumsum(each) - each
    out[origin] = tokens[np.searchsorted(key, heads.astype(np.int64) << 32)]
    return out.tolist()


_machine: dict[str, Transducer] = {}


def machine_for(path: str) -> Transducer:
    if path not in _machine:
        _machine[path] = Transducer(path)
    return _machine[path]


def groups(texts: pa.Array, most: int = BATCH) -> Iterator[list[str]]:
    """Texts in order, in lists of about so many characters."""
    group, held = [], 0
    for t in texts:
        group.append(t.as_py() or "")
        held += len(group[-1])
        if held >= most:
            yield group
            group, held = [], 0
    yield group


def _counted(path: str, over: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [n for g in groups(b.column("text")) for n in count_texts(machine_for(path), g)]
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(tokens, pa.int64()), pa.array([n > over for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def token_counts(docs: DataFrame, model: str | None = None, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs (doc_id, text).

    Other columns are ignored; a null text counts as empty (no bytes, no tokens);
    repeated rows each get a row. ``model`` is the path of a sentencepiece BPE model
    with byte fallback that leaves its texts as they are.
    """
    return docs.select("doc_id", "text").mapInArrow(_counted(model or public_tokenizers.path(MODEL), over), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
