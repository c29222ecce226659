"""Token counts from a tokenizer compiled to a deterministic finite-state transducer.

The vocabulary is a SentencePiece BPE model with byte fallback. Reading a text left to right, the
last token of each prefix's encoding is unique: it is the vocabulary piece t that ends there and
may follow the last token u of what lies before it, which holds if t and u together encode as
(u, t). So the last tokens at those positions from which a piece may still reach further decide
what the next character does. They are the transducer's states; a transition carries the
change in the number of tokens. Transitions are compiled when first met, and the machine is
dropped and begun anew when it has grown to its bound.

No piece holds a line end, nor a word mark after another character, so there the machine returns to
its first state. A text is cut into chunks. A chunk is a map from the state at its entry to the
state at its exit and the tokens between: up to its first return the entry state decides, and
behind it nothing does, so a map is kept as the characters before the first return, and the tokens
and the exit state behind it. Maps are composed by pairs in a scan, without reading chunks again.
Chunks met before have their map already: cuts are made at returns, by content, so that passages
that texts share give the same chunks.

Null counts as the empty text. One row comes out for each row, repeated rows and null ids included;
other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

MARK = "▁"
#: Stretches that encode apart: the line end is no piece's part, so it splits them as well.
STRETCH = re.compile(f"{MARK}+[^{MARK}\n]*|\n+|[^{MARK}\n]+")
#: Where the machine is in its first state again.
RETURN = re.compile(f"(?<=[^{MARK}])(?={MARK})|(?<=[^\n])(?=\n)|(?<=\n)(?=[^\n])")
INSIDE = re.compile(f"[^{MARK}]{MARK}")


class Entry(NamedTuple):
    """Where the machine is: its state, and the last character read, None at the begin."""

    state: State
    last: str | None


class ChunkMap(NamedTuple):
    """What a chunk does: head is read from the entry; if returns, tokens come behind it and exit is where the machine then is."""

    head: str
    returns: bool = False
    tokens: int = 0
    exit: Entry | None = None


class State(dict):
    """Transitions by character: the next state, and the change in the number of tokens.

    A position is open while what follows it begins some piece. A state has the characters since
    the first open position and, for each position from there on that is open, the token that
    ends there and the tokens up to it, less those now.
    """

    __slots__ = ("machine", "text", "tokens", "counts")

    def __init__(self, machine: Transducer, text: str, tokens: tuple, counts: tuple):
        self.machine, self.text, self.tokens, self.counts = machine, text, tokens, counts

    def __missing__(self, char: str) -> tuple[State, int]:
        found = self[char] = self.machine.compile(self, char)
        return found


class Transducer:
    def __init__(self, path: str, most: int = 1_000_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
        if any(INSIDE.search(p) for p in self.score) or any("\n" in p for p in self.score):
            raise ValueError("pieces that hold a word mark or a line end inside")
        self.longest = max(map(len, self.score))
        self.begun = {p[:i] for p in self.score for i in range(1, len(p))}
        self.most, self.split = most, {}
        self.forget()

    def forget(self) -> None:
        """The empty machine."""
        self.start = State(self, "", ("",), (0,))
        self.states = {("", ("",), (0,)): self.start}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.moves = 0

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The model's merges over a short string: its tokens, and the two that the last merge joined."""
        parts, score, last = list(text), self.score, None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def halves(self, t: str) -> tuple[str, str] | None:
        """What a token was joined from; None for a character, False for a piece that merges never give."""
        found = self.split.get(t, 0)
        if found == 0:
            parts, found = self.merged(t) if len(t) > 1 else ([t], None)
            found = self.split[t] = found if parts == [t] else False
        return found

    def follows(self, u: str, t: str) -> bool:
        """Whether u and t encode as (u, t) together."""
        found = self.pairs.get((u, t))
        if found is None:
            found = self.pairs[u, t] = self._follows(u, t)
        return found

    def _follows(self, u: str, t: str) -> bool:
        """Tries it.

        The merges that made them are taken back, the latest first. If what then faces each other
        at the seam would have been joined before the merge taken back, they do not.
        """
        a, b = self.halves(u), self.halves(t)
        if a is False or b is False:
            return False
        score, joined = self.score, self.score.get(u + t)
        if joined is not None:
            return False
        while a or b:
            # Of equal merges the left one comes first, so the right one is taken back first.
            if b and (not a or score[t] <= score[u]):
                made, t = score[t], b[0]
                b, left = self.halves(t), True
            else:
                made, u = score[u], a[1]
                a, left = self.halves(u), False
            joined = score.get(u + t)
            if joined is not None and (joined > made or joined == made and left):
                return False
        return True

    def compile(self, state: State, char: str) -> tuple[State, int]:
        text, tokens, counts = state.text, state.tokens, state.counts
        grown, n, score = text + char, len(text) + 1, self.score
        for size in range(1, min(self.longest, n) + 1):
            t = grown[n - size :]
            if (size == 1 or t in score) and ((u := tokens[n - size]) == "" and self.halves(t) is not False or u and self.follows(u, t)):
                break
        else:
            raise AssertionError(f"no token ends {grown!r}")
        change = counts[n - size] + (1 if t in score else len(t.encode()))
        open_ = [i for i in range(max(0, n - self.longest + 1), n) if grown[i:] in self.begun]
        text = grown[open_[0] :] if open_ else ""
        now = [tokens[i] if i < n else t for i in (*open_, n)]
        then = [counts[i] - change if i < n else 0 for i in (*open_, n)]
        if open_ and len(open_) < n - open_[0]:  # closed positions in between
            now = [now[open_.index(i)] if i in open_ else None for i in range(open_[0], n)] + [t]
            then = [then[open_.index(i)] if i in open_ else 0 for i in range(open_[0], n)] + [0]
        new = (text, tuple(now), tuple(then))
        found = self.states.get(new)
        if found is None:
            found = self.states[new] = State(self, *new)
        self.moves += 1
        return found, change

    def run(self, state: State, stretch: str) -> tuple[State, int]:
        """Reads part of a stretch from a state: the state it leads to and the tokens that come to those before."""
        total = 0
        for c in stretch:
            state, change = state[c]
            total += change
        return state, total

    def read(self, entry: Entry, text: str) -> tuple[Entry, int]:
        """Reads a text from where the machine is."""
        if not text:
            return entry, 0
        state, last, total = entry.state, entry.last, 0
        for stretch in STRETCH.findall(text):
            first = stretch[0]
            if last is None or first == "\n" or last == "\n" or first == MARK and last != MARK:
                state = self.start
            if first == "\n":
                total += len(stretch)
            else:
                state, n = self.run(state, stretch)
                total += n
            last = stretch[-1]
        return Entry(state, last), total

    def map(self, chunk: str) -> ChunkMap:
        """A chunk's map."""
        at = RETURN.search(chunk)
        if at is None:
            return ChunkMap(chunk)
        exit_, tokens = self.read(Entry(self.start, None), chunk[at.start() :])
        return ChunkMap(chunk[: at.start()], True, tokens, exit_)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b."""
        if not a.returns:
            whole = a.head + b.head
            at = RETURN.search(whole)
            if at is None:
                # The seam itself may be a return that neither half shows.
                return b._replace(head=whole)
            exit_, tokens = self.read(Entry(self.start, None), whole[at.start() :])
            return ChunkMap(whole[: at.start()], True, tokens + b.tokens, b.exit if b.returns else exit_)
        exit_, tokens = self.read(a.exit, b.head)
        return ChunkMap(a.head, True, a.tokens + tokens + b.tokens, b.exit if b.returns else exit_)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """The product of the maps, by pairs, as a parallel scan takes them."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str | None, chunk: int = 1 << 12) -> int:
        """Tokens of a whole text, read in chunks of so many characters."""
        if not text:
            return 0
        if self.moves >= self.most:
            self.forget()
        s = MARK + text.replace(" ", MARK)
        whole = self.scan([self.map(s[i : i + chunk]) for i in range(0, len(s), chunk)])
        return self.read(Entry(self.start, None), whole.head)[1] + whole.tokens


_machines: dict[str, Transducer] = {}


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, n_bytes, n_tokens and over_limit. model: a path all executors can read."""
    small_batches(docs.sparkSession, 500)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _machines:
            _machines[model] = Transducer(model)
        count = _machines[model].count
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([count(t) for t in b.column(2).to_pylist()], pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(work, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
