"""Exact token counts at every prefix, by dynamic programming.

The tokens of a BPE text have optimal substructure: the encoding of a prefix that ends with token t
is the encoding of the prefix without t, followed by t, and t is the only token ending there that may
follow that prefix's own last token.  So one pass stores, for every prefix, its last token and its
count, and later questions (how many tokens has this prefix, where does a budget of n tokens end) are
look-ups.

In this vocabulary no piece has a blank after another character, nor a letter beside a sign, so merges
never cross such places: the table is kept in two levels, running counts at every such place for the
document, and a table of its own for each distinct word, worked out once in a worker.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldledger.llm.base import add_columns, read_table

VOCABULARY = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: Words up to this many characters are remembered by a worker, and so many of them.
CACHED_CHARS, CACHED = 64, 800_000
BLANK = "▁"
#: A text that common normalisers would change: runs of blanks, compatibility forms, a combining mark, a tab.
PROBE = "  a  b\tc\u00a0\u00e9\u2460e\u0301 \ufb01 "


def splits(pieces) -> list[re.Pattern]:
    """Ways to cut a text at places that no piece may cross, finest first."""
    odd = "".join(sorted({c for p in pieces for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
    return [
        re.compile(rf"{BLANK}*(?:[^\W\d_{odd}]+|(?:(?!{BLANK})[\W\d_{odd}])+)|{BLANK}+"),
        re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+"),
    ]


class PrefixCounter:
    """Tables of prefix counts over one sentencepiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if self.model.normalize(PROBE) != BLANK + PROBE.replace(" ", BLANK):
            raise ValueError("the model's normaliser changes texts; prefixes of the text aren't prefixes of what it encodes")
        n = self.model.get_piece_size()
        self.scores: dict[str, float] = {}
        for i in range(n):
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)):
                self.scores[self.model.id_to_piece(i)] = self.model.get_score(i)
        self.split = next(p for p in splits(self.scores) if all(len(p.findall(x)) <= 1 for x in self.scores))
        #: Sizes of the pieces that their own characters merge into, by the last two characters.
        sizes: dict[str, set[int]] = {}
        for piece in self.scores:
            if len(piece) > 1 and self.merged(piece) == [piece]:
                sizes.setdefault(piece[-2:], set()).add(len(piece))
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}
        self.words: dict[str, tuple[int, ...]] = {}
        self.follows = lru_cache(500_000)(self._follows)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best-scored pair, leftmost first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, left: str, right: str) -> bool:
        """True if ``right`` may come straight after ``left`` in an encoding."""
        return self.merged(left + right) == [left, right]

    def cost(self, piece: str) -> int:
        return 1 if piece in self.scores else len(piece.encode("utf-8"))

    def table(self, word: str) -> tuple[int, ...]:
        """counts[k] = tokens of the first k characters; counts[0] = 0.

        A character outside the vocabulary is a piece of its own and costs its UTF-8 bytes.
        """
        scores, sizes, follows = self.scores, self.sizes.get, self.follows
        last, counts = [""], [0]
        for k in range(1, len(word) + 1):
            for size in sizes(word[k - 2 : k], ()) if k > 1 else ():
                if size <= k and (piece := word[k - size : k]) in scores:
                    left = last[k - size]
                    if not left or follows(left, piece):
                        last.append(piece)
                        counts.append(counts[k - size] + 1)
                        break
            else:
                last.append(word[k - 1])
                counts.append(counts[k - 1] + self.cost(word[k - 1]))
        return tuple(counts)

    def word(self, word: str) -> tuple[int, ...]:
        got = self.words.get(word)
        if got is None:
            got = self.table(word)
            if len(word) <= CACHED_CHARS:
                if len(self.words) >= CACHED:
                    self.words.clear()
                self.words[word] = got
        return got


@lru_cache(maxsize=1)
def counter_of(model_file: str) -> PrefixCounter:
    """One counter, with the words it knows, for all tasks of a worker."""
    return PrefixCounter(model_file)


class PrefixTable:
    """Token counts of every prefix of one text."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter = counter
        #: The library writes blanks as U+2581 and puts one before the text.
        self.words = counter.split.findall(BLANK + text.replace(" ", BLANK)) if text else []
        known, word = counter.words.get, counter.word
        self.tables = [known(w) or word(w) for w in self.words]
        self.counts = list(accumulate([t[-1] for t in self.tables], initial=0))

    @property
    def total(self) -> int:
        return self.counts[-1]

    def every(self) -> list[int]:
        """Tokens of the first 0, 1, 2 ... characters, to the whole text."""
        out = [0]
        for base, table in zip(self.counts, self.tables):
            out += [base + n for n in table[1:]]
        return [0, *out[2:]]  # the leading blank is no character of the text

    def starts(self) -> list[int]:
        """Offsets of the words in the text with its leading blank."""
        return list(accumulate(map(len, self.words), initial=0))

    def at(self, n_chars: int) -> int:
        """Tokens of the first ``n_chars`` characters."""
        if n_chars <= 0 or not self.words:
            return 0
        starts = self.starts()
        k = min(n_chars + 1, starts[-1])
        i = bisect_right(starts, k) - 1
        return self.counts[i] + (self.tables[i][k - starts[i]] if i < len(self.tables) else 0)

    def fit(self, budget: int) -> int:
        """The most characters of a prefix that has ``budget`` tokens at most.

        Counts can fall by a few when a merge completes, so all prefixes of the words around the
        budget are looked at, not only the first that is above it.
        """
        if not self.words:
            return 0
        if self.total <= budget:
            return len_text(self.words)
        # Whole words only add tokens: the answer lies in the first word that ends above the budget, or before.
        i = bisect_right(self.counts, budget) - 1
        start = sum(map(len, self.words[:i]))
        room = budget - self.counts[i]
        table = self.tables[i]
        best = max(k for k in range(len(table)) if table[k] <= room)
        return max(0, start + best - 1)


def len_text(words: list[str]) -> int:
    return sum(map(len, words)) - 1


def with_token_counts(docs: DataFrame, text: str = "text", limit: int = TOKEN_LIMIT, path: str | None = None, prefix_tables: bool = False) -> DataFrame:
    """Adds n_bytes, n_tokens, over_limit and limit_chars (the longest prefix within the limit) to ``docs``.

    With ``prefix_tables`` also prefix_tokens: the exact count at every prefix, by its characters; ``count_at`` and
    ``chars_within`` answer from that column.  A null or empty text has no tokens; texts of any length are
    counted whole; equal texts have equal counts, so repeated rows do; clashing extra columns are
    replaced; an empty table gives no rows.  The text stays.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)

    def make():
        counter = counter_of(path)

        def rows(texts):
            sizes, totals, fits, tokens = [], [], [], []
            for t in texts:
                t = t or ""
                table = PrefixTable(counter, t)
                sizes.append(len(t.encode("utf-8")))
                totals.append(table.total)
                fits.append(table.fit(limit))
                if prefix_tables:
                    tokens.append(table.every())
            out = [sizes, totals, [n > limit for n in totals], fits]
            return [*out, tokens] if prefix_tables else out

        return rows

    schema = "n_bytes long, n_tokens long, over_limit boolean, limit_chars long"
    if prefix_tables:
        schema += ", prefix_tokens array<int>"
    return add_columns(docs, [text], schema, make)


def count_at(n_chars: Column | int, prefix_tokens: str = "prefix_tokens") -> Column:
    """Tokens of the first ``n_chars`` characters, from the stored counts; below 0 none, past the end those of all."""
    n = n_chars if isinstance(n_chars, Column) else F.lit(n_chars)
    return F.get(prefix_tokens, F.greatest(F.lit(0), F.least(n, F.size(prefix_tokens) - 1)).cast("int"))


def chars_within(budget: Column | int, prefix_tokens: str = "prefix_tokens") -> Column:
    """The most characters of a prefix with ``budget`` tokens at most, from the stored counts; null if not even none fits.

    Counts can fall when a merge completes, so the last prefix within the budget counts.
    """
    b = budget if isinstance(budget, Column) else F.lit(budget)
    fits = F.transform(prefix_tokens, lambda n: n <= b)
    at = F.size(fits) - F.array_position(F.reverse(fits), F.lit(True))
    return F.when(F.exists(fits, lambda x: x), at)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs).drop("text")
