"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

Of a byte-pair encoding it is enough to know the last token of every prefix. A run of
tokens is an encoding exactly if each two that adjoin are the encoding of their bytes,
so the last token of a prefix is the one that ends there and follows the last token of
the prefix before it; the count is one more than there. Tokens that end at a place come
from an automaton over the vocabulary, pairs are asked of the tokenizer once.

A text is cut into stretches of white space with the word, number or marks behind them.
What a prefix of a text counts that ends in a stretch is what the stretches before it
count and that part of the stretch, so a worker remembers the steps of the stretches it
has met, and a text's counts are their running sum.
"""

import re
import sys
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import kept_by_worker, over_batches
from hearthlog.llm.packing import _BYTE_LETTERS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMIT = 512
MOST_STRETCHES_KEPT = 400_000  # of a worker's memory: the first, so the frequent ones
MOST_PAIRS_KEPT = 2_000_000
LONG_TEXT = 1 << 20  # characters from which a text is taken in blocks
BLOCK = 1 << 16
PREFIXES_AT_ONCE = 1 << 21  # that are handed on in one batch

# Classes of the pattern that the tokenizer splits text by, up to U+00FF.
_SPACE = r"\t-\r \x85\xa0"
_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SUFFIX = r"'(?:[stmd]|re|ve|ll)"

_CORE = rf"[{_LETTER}]+|[{_NUMBER}]+|[^{_SPACE}{_LETTER}{_NUMBER}]+"
STRETCH = re.compile(rf"{_SUFFIX}|(?:[{_SPACE}]* )?(?:{_CORE})|[{_SPACE}]+(?:{_SUFFIX}|{_CORE})?")
_PARTS = re.compile(rf"([{_SPACE}]*)(.*)", re.DOTALL)
_IS_SUFFIX = re.compile(_SUFFIX)


class Prefixes(dict):
    """For each stretch, the steps of the count at each of its characters, as
    little-endian integers, for a byte-level tokenizer file with one pattern."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("special tokens that take in what stands around them")
        byte = {letter: b for b, letter in enumerate(_BYTE_LETTERS)}
        self.letters, self.ends = {}, ahocorasick.Automaton()
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.letters[number] = token
            self.ends.add_word("".join([chr(byte[c]) for c in token]), (number, len(token)))
        self.ends.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.classes = _Classes(self.tokenizer)

    def _follow(self, before: int, after: int) -> bool:
        """Whether two tokens are the encoding of their bytes; ``before`` may be none, -1."""
        known = self.pairs.get((before, after))
        if known is None:
            text = self.letters.get(before, "") + self.letters[after]
            ids = [t.id for t in self.tokenizer.model.tokenize(text)]
            known = ids == ([after] if before < 0 else [before, after])
            if len(self.pairs) >= MOST_PAIRS_KEPT:
                self.pairs.clear()
            self.pairs[before, after] = known
        return known

    def counts(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece that the pattern does not split, from the
        empty one on."""
        data = piece.encode()
        last, count = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        for end, (number, size) in self.ends.iter(data.decode("latin-1")):
            at, start = end + 1, end + 1 - size
            if not count[at] and (not start or count[start]) and self._follow(last[start], number):
                last[at], count[at] = number, count[start] + 1
        if len(data) == len(piece):
            return count
        return [count[0], *[count[i] for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]]

    def _core(self, core: str) -> list[int]:
        found = self.counts(core)
        if len(core) == 3 and _IS_SUFFIX.fullmatch(core):  # its first two letters alone are no suffix
            found[2] = self.counts(core[0])[1] + self.counts(core[1])[1]
        return found

    def __missing__(self, stretch: str) -> bytes:
        space, core = _PARTS.fullmatch(self.classes.plain(stretch)).span(1)[1], len(stretch)
        within = self.counts(stretch[:space])  # a prefix that ends in the white space
        if core == space:
            found = within
        elif stretch[space - 1 : space] == " ":  # the last blank goes with the word
            found = within + [within[space - 1] + n for n in self.counts(stretch[space - 1 :])[2:]]
        elif space:
            before = within[space - 1] + self.counts(stretch[space - 1 : space])[-1]
            found = within + [before + n for n in self._core(stretch[space:])[1:]]
        else:
            found = self._core(stretch)
        steps = np.diff(np.array(found, "<i4")).tobytes()
        if len(self) < MOST_STRETCHES_KEPT:
            self[stretch] = steps
        return steps

    def _sections(self, text: str) -> Iterator[tuple[str, bool]]:
        """Text between special tokens, and whether one ends it."""
        at = 0
        while self.special:
            found = [(i, -len(s), s) for s in self.special if (i := text.find(s, at)) >= 0]
            if not found:
                break
            start, _, special = min(found)
            yield text[at:start], special
            at = start + len(special)
        yield text[at:], ""

    def running(self, text: str) -> Iterator[np.ndarray]:
        """The counts of the prefixes of one, two, ... characters, in blocks."""
        base = 0
        for section, special in self._sections(text):
            if special:  # until its last character is there, it is a text like any other
                whole = sum(int(np.frombuffer(self._joined(b), "<i4").sum()) for b in self._stretches(section))
                section += special[:-1]
            after = base
            for block in self._stretches(section):
                counts = after + np.cumsum(np.frombuffer(self._joined(block), "<i4"))
                if len(counts):
                    after = int(counts[-1])
                    yield counts
            if special:
                after = base + whole + 1
                yield np.array([after])
            base = after

    def _joined(self, stretches: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, stretches))

    def _stretches(self, text: str) -> Iterator[list[str]]:
        plain = self.classes.plain(text)
        if plain is text and len(text) < LONG_TEXT:
            yield STRETCH.findall(text)
            return
        spans = STRETCH.finditer(plain)
        while block := [text[m.start() : m.end()] for m in islice(spans, BLOCK)]:
            yield block


class _Classes(dict):
    """For each character beyond U+00FF, one up to there of its class: what the
    tokenizer's own pattern takes it for."""

    def __init__(self, tokenizer):
        super().__init__((c, c) for c in range(256))
        self.tokenizer = tokenizer

    def __missing__(self, code: int) -> int:
        one = lambda before: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(before + chr(code))) == 1
        self[code] = next((ord(c) for c in "a1!" if one(c)), 9)
        return self[code]

    def plain(self, text: str) -> str:
        """The text with such characters replaced; the text itself if it has none."""
        if text.isascii():
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.translate(self)
        return text


def prefix_counter(path: str) -> Prefixes:
    return kept_by_worker(f"prefixes_{path}", lambda: Prefixes(path))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> Callable[[], str]:
    """Where the workers have a public tokenizer."""

    def find() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return find


def count_tokens(
    docs: DataFrame,
    path: Callable[[], str] | str | None = None,
    limit: int = LIMIT,
    prefixes: bool = False,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, chars_in_limit``: a row per row of ``docs``.

    Tokens are those of the tokenizer file ``path`` (or what finds it on a worker),
    with special tokens where their text stands and none added. ``chars_in_limit`` is the
    largest number of characters (code points) whose text alone has at most ``limit``
    tokens. With ``prefixes``, ``prefix_tokens`` has the count of every prefix of one,
    two, ... characters, taken as a text of its own: see ``tokens_of_prefix`` and
    ``longest_prefix``.

    A null text is an empty one, which has no tokens. Other columns are not read, and
    rows that repeat are rows of their own. Texts are never cut; the memory of a task
    follows its longest text.
    """
    where = path if callable(path) else tokenizer_file() if path is None else lambda: path

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = prefix_counter(where())
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1).cast(pa.binary())), 0).to_numpy()
            keys, n, at, counts, total, within = batch.column(0), 0, 0, [], [], []
            for place, value in enumerate(batch.column(1)):
                found, seen, fits = [], 0, 0
                for part in known.running(value.as_py() or ""):
                    below = np.flatnonzero(part <= limit)
                    fits = seen + int(below[-1]) + 1 if len(below) else fits
                    seen += len(part)
                    last = int(part[-1])
                    if prefixes:
                        found.append(part.astype(np.int32))
                total.append(last if seen else 0)
                within.append(fits)
                counts.append(np.concatenate(found) if found else np.empty(0, np.int32))
                n += seen
                if (prefixes and n >= PREFIXES_AT_ONCE) or place == batch.num_rows - 1:
                    yield {
                        "doc_id": keys.slice(at, len(total)), "n_bytes": sizes[at : place + 1].astype(np.int64),
                        "n_tokens": total, "over_limit": [t > limit for t in total], "chars_in_limit": within,
                        "prefix_tokens": counts,
                    }
                    n, at, counts, total, within = 0, place + 1, [], [], []

    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, chars_in_limit long"
    return over_batches(chosen, rows, schema + (", prefix_tokens array<int>" if prefixes else ""))


def tokens_of_prefix(prefix_tokens: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` characters; of all, if there are fewer."""
    at = F.least(chars, F.size(prefix_tokens)).cast("int")
    return F.when(at > 0, F.get(prefix_tokens, at - 1)).otherwise(F.lit(0))


def longest_prefix(prefix_tokens: Column, budget: Column) -> Column:
    """The most characters whose text alone has at most ``budget`` tokens."""
    fits = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i + 1))
    return F.coalesce(F.array_max(fits), F.lit(0))
