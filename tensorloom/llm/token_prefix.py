"""Exact token counts at every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

Byte-level BPE first cuts a text into pieces and then encodes each piece by itself.  Within a piece, an encoding is
right exactly if each token and each two neighbouring tokens encode to themselves.  So for the first k bytes of a piece
there is one last token t such that t can follow the last token of the first k - len(t) bytes, and the number of tokens
of k bytes is one more than that of k - len(t).  One left-to-right pass over a piece stores the count of every prefix.

Whether two tokens may be neighbours is decided by undoing their merges from the latest on: they may not if, at some step,
the parts that touch would have been merged earlier than what is undone.  Tokens that end at a place come from an
automaton over the vocabulary for long pieces, so a piece of any length takes time in proportion to it.

A piece only depends on the text from its start on, and a prefix that ends inside a piece leaves all earlier pieces as
they are, but for white space before it and for added tokens that it cuts, where counting starts a piece earlier.  Counts
of all prefixes of a text are therefore a running sum over pieces plus the counts within the last one: ``fit`` finds the
longest prefix within a budget, and ``count_prefix`` counts any prefix, by looking counts up.

The pass is over the text alone, without a shuffle; words met before are looked up, in a table whose size is bounded.

Defined results: a null or empty text has 0 bytes and 0 tokens; strings of added tokens inside a text count as these
tokens, as the tokenizers library has it by default; equal rows are counted each on its own; a null doc_id is carried
through; columns other than the two named ones are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tensorloom.llm import _tables

#: Fixed value: how a byte-level BPE tokenizer of this kind cuts a text into pieces.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: White space of Latin-1 besides the space and the line feed.
_OTHER_SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0"
#: Entries after which a table of words is emptied; it only saves time.
TABLE_LIMIT = 1_300_000
#: The same for pairs of tokens known to be neighbours or not.
PAIR_LIMIT = 1_000_000
#: Bytes from which a piece is passed over with the automaton, and not kept in the table.
LONG_PIECE = 200
_CONTRACTION = regex.compile("'(?:s|t|re|ve|m|ll|d)")


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable bytes stand for themselves, others follow from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    table = {chr(b): b for b in shown}
    table |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return table


class PrefixCounter:
    """Token counts of prefixes under the byte-level BPE tokenizer in a tokenizers ``.json`` file."""

    _loaded: dict[str, PrefixCounter] = {}

    @classmethod
    def load(cls, path: str) -> PrefixCounter:
        """The counter of a file, read once in each Python worker."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path}: not a byte-level BPE tokenizer without a normalizer")
        byte = _bytes_of_symbols()
        as_bytes = lambda symbols: bytes(byte[c] for c in symbols)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(pairs)}
        added = [t["content"] for t in spec["added_tokens"]]
        tokens = {as_bytes(t) for t in model["vocab"] if t not in added}
        self.longest = max(map(len, tokens))
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        #: Of each token that more than one merge makes, only the one counts that its own encoding ends with.
        made: dict[bytes, list[tuple[bytes, bytes]]] = {}
        for pair in self.rank:
            made.setdefault(pair[0] + pair[1], []).append(pair)
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        self.tokens = {t for t in tokens if len(t) == 1}
        for token, ways in made.items():
            if token in tokens:
                steps = self._merged(token)
                if steps and steps[-1][0] + steps[-1][1] == token:
                    self.tokens.add(token)
                    self.parts[token] = steps[-1] if len(ways) > 1 else ways[0]
        self.late = {t: self.rank[p] for t, p in self.parts.items()}
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self._automaton = None
        #: Of each piece met, for each of its prefixes: the length of its last token, and its token count.
        self.prefixed: dict[bytes, tuple[Sequence[int], Sequence[int]]] = {}
        self.chunks: dict[str, int] = {}
        self._long: tuple[bytes, tuple[Sequence[int], Sequence[int]]] = (b"", ([0], [0]))

    def clear(self) -> None:
        """Forget all words met."""
        self.follows, self.prefixed, self.chunks, self._long = {}, {}, {}, (b"", ([0], [0]))

    def _merged(self, data: bytes) -> list[tuple[bytes, bytes]]:
        """The merges that encode one short piece, in order: the best-ranked neighbours first, leftmost first."""
        parts, steps = [data[i : i + 1] for i in range(len(data))], []
        rank = self.rank.get
        while len(parts) > 1:
            ranks = [rank(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            at = ranks.index(best)
            steps.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return steps

    def _neighbours(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of a + b is a, b.

        Both are taken apart again, latest merge first (of equal ones the right token's, as merging goes from the left).
        What then touches must not have been merged before the merge undone last, or at the same rank further left.
        """
        rank, late, parts = self.rank.get, self.late.get, self.parts
        undone = 1 << 60
        while True:
            if rank((a, b), 1 << 60) < undone:
                return False
            x, y = late(a, -1), late(b, -1)
            if x < 0 and y < 0:
                return True
            if x > y:
                undone, a = x, parts[a][1]
            else:
                # A pair of the same rank across the border stands left of b's own and would have come first.
                undone, b = y + 1, parts[b][0]

    def _pass(self, data: bytes) -> tuple[Sequence[int], Sequence[int]]:
        """Of every prefix of one short piece, the length of its last token and its token count."""
        n = len(data)
        known, at = None, n
        while known is None and at > 1:  # a word met before that this one continues
            at -= 1
            known = self.prefixed.get(data[:at])
        size, count = ([*known[0]], [*known[1]]) if known is not None else ([0], [0])
        tokens, follows, longest = self.tokens, self.follows, self.longest
        for k in range(len(size), n + 1):
            for j in range(k - longest if k > longest else 0, k):
                token = data[j:k]
                if token not in tokens:
                    continue
                if j:
                    pair = (data[j - size[j] : j], token)
                    fine = follows.get(pair)
                    if fine is None:
                        if len(follows) >= PAIR_LIMIT:
                            follows.clear()
                        fine = follows[pair] = self._neighbours(*pair)
                    if not fine:
                        continue
                size.append(k - j)
                count.append(count[j] + 1)
                break
        return bytes(size), bytes(count)

    def _long_pass(self, data: bytes) -> tuple[Sequence[int], Sequence[int]]:
        """As ``_pass`` for a piece of any length, in time linear in it: matches of the vocabulary, longest first at each place."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for token in self.tokens:
                self._automaton.add_word(token.decode("latin-1"), token)
            self._automaton.make_automaton()
        size, count, follows, done = array("i", bytes(4 * (len(data) + 1))), array("i", bytes(4 * (len(data) + 1))), self.follows, 0
        for end, token in self._automaton.iter(data.decode("latin-1")):
            k = end + 1
            if k == done:
                continue
            j = k - len(token)
            if j:
                pair = (data[j - size[j] : j], token)
                fine = follows.get(pair)
                if fine is None:
                    if len(follows) >= PAIR_LIMIT:
                        follows.clear()
                    fine = follows[pair] = self._neighbours(*pair)
                if not fine:
                    continue
            size[k], count[k], done = len(token), count[j] + 1, k
        return size, count

    def _table(self, data: bytes) -> tuple[Sequence[int], Sequence[int]]:
        if len(data) >= LONG_PIECE:  # only the last one is kept
            if self._long[0] != data:
                self._long = (data, self._long_pass(data))
            return self._long[1]
        found = self.prefixed.get(data)
        if found is None:
            found = self._pass(data)
            if len(self.prefixed) >= TABLE_LIMIT:
                self.prefixed.clear()
            self.prefixed[data] = found
        return found

    def piece(self, piece: str) -> Sequence[int]:
        """Counts at every byte prefix of one piece, 0 to its length."""
        return self._table(piece.encode("utf-8", "surrogatepass"))[1]

    def _total(self, piece: str) -> int:
        return self._table(piece.encode("utf-8", "surrogatepass"))[1][-1]

    def _chunk(self, chunk: str) -> int:
        body = chunk[1:] if chunk[0] == " " else chunk
        if body.isalpha():  # letters are one piece, and so is one sign behind them
            total = self._total(chunk)
        elif body[-1] in ".,!?;:" and body[:-1].isalpha():
            total = self._total(chunk[:-1]) + 1
        else:
            total = sum(map(self._total, PIECES.findall(chunk)))
        if len(self.chunks) >= TABLE_LIMIT:
            self.chunks.clear()
        if len(chunk) < 200:
            self.chunks[chunk] = total
        return total

    def _plain(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        if not text:
            return 0
        single = "  " not in text and " \n" not in text and "\n " not in text and text[-1] != " "
        if not single or any(c in text for c in _OTHER_SPACES) or not _latin(text):
            return sum(map(self._total, PIECES.findall(text)))
        # Single spaces alone between solid characters: each begins a piece, so words can be counted by themselves.
        first, *rest = text.split(" ")
        known, total = self.chunks, self._chunk(first) if first else 0
        for word in rest:
            n = known.get(chunk := " " + word)
            total += self._chunk(chunk) if n is None else n
        return total

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return sum(map(self._plain, self.special.split(text))) + len(self.special.findall(text))

    def spans(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """(start, end, whether an added token) of every piece, in code points."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            # A piece looks at what follows it, and an added token ends the text before it.
            yield from ((at + p.start(), at + p.end(), False) for p in PIECES.finditer(text[at : m.start()]))
            yield m.start(), m.end(), True
            at = m.end()
        yield from ((p.start(), p.end(), False) for p in PIECES.finditer(text, at))

    def prefixes(self, text: str, budget: int | None = None) -> tuple[list[tuple[int, int, bool]], list[int]]:
        """The pieces and the count before each of them (one more: of all); with a budget, only those that can matter for it."""
        spans, sums, beyond = [], [0], 0
        for span in self.spans(text):
            spans.append(span)
            sums.append(sums[-1] + (1 if span[2] else self._total(text[span[0] : span[1]])))
            beyond += budget is not None and sums[-1] > budget
            if beyond > 2:
                break
        return spans, sums

    def _ends(self, text: str, spans, sums, k: int, first: int, last: int) -> Iterator[int]:
        """Tokens of the first n code points for each n from first to last, all within piece ``k``, from stored counts."""
        start, end, added = spans[k]
        if added:
            # A cut added token is plain text and may lengthen the piece before it; it is a few characters.
            whole, at = sums[k + 1], k - 1 if k and not spans[k - 1][2] else k
            for n in range(first, last + 1):
                yield whole if n == end else sums[at] + self._plain(text[spans[at][0] : n])
            return
        # White space that ends a text is one piece, whatever would follow.
        run = k - 1 if k and not spans[k - 1][2] and text[spans[k - 1][0] : spans[k - 1][1]].isspace() else k
        blank = end - len(text[start:end].lstrip())
        if start < blank and first <= blank:
            space = text[spans[run][0] : blank]
            counts, size = self.piece(space), len(text[spans[run][0] : first].encode("utf-8", "surrogatepass"))
            for n in range(first, min(last, blank) + 1):
                yield sums[run] + counts[size]
                size += _width(text[n]) if n < blank else 0
            first = blank + 1
        if first > last:
            return
        body = text[start:end]
        if _CONTRACTION.fullmatch(body):
            for n in range(first, last + 1):
                yield sums[k] + self._plain(text[start:n])
            return
        counts, size = self.piece(body), len(text[start:first].encode("utf-8", "surrogatepass"))
        for n in range(first, last + 1):
            yield sums[k] + counts[size]
            size += _width(text[n]) if n < end else 0

    def count_prefix(self, text: str, n: int, table=None) -> int:
        """Tokens of the first ``n`` code points; ``table`` is what ``prefixes`` gave for the text."""
        spans, sums = table or self.prefixes(text)
        k = bisect_left(spans, n, key=lambda span: span[0]) - 1  # the last piece that starts before n
        return 0 if k < 0 else next(self._ends(text, spans, sums, k, n, n))

    def fit(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens: stored counts are looked up, nothing is encoded again."""
        spans, sums = self.prefixes(text, budget)
        if sums[-1] <= budget:
            return len(text)
        k = bisect_left(sums, budget) - 1  # the last piece with fewer tokens before it
        for j in range(min(k + 1, len(spans) - 1), max(-1, k - 2), -1):  # a cut may join the piece before it
            best = 0
            for n, many in enumerate(self._ends(text, spans, sums, j, spans[j][0] + 1, spans[j][1]), spans[j][0] + 1):
                if many <= budget:
                    best = n
            if best:
                return best
        return 0 if k < 0 else spans[k][0]


def _width(c: str) -> int:
    """Bytes of a code point in UTF-8."""
    x = ord(c)
    return 1 if x < 0x80 else 2 if x < 0x800 else 3 if x < 0x10000 else 4


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def token_counts(docs: DataFrame, tokenizer: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: the code points of the longest prefix within the limit.

    ``tokenizer`` is the path of a tokenizers ``.json`` file on every executor.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.load(tokenizer)
        _tables.enter("prefixes", counter.clear)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = [counter.count(t) for t in texts]
                sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
                fits = [len(t) if n <= limit else counter.fit(t, limit) for t, n in zip(texts, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts]), pa.array(fits, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(judge, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
