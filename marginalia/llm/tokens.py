"""Token counts of a public byte-level tokenizer, and its pre-tokens.

A byte-level BPE encodes each pre-token by itself, so a text's count is the sum over its pre-tokens. Pre-tokens are
found by the C regex engine and their counts remembered, which is faster than encoding every text anew.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.batches import values

#: Where the rank file lies; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The published split pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts of PLAIN characters only, in the faster engine.
FAST = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: The same for characters of code page 1252 except DOUBTFUL.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿŒœŠšŸŽžƒˆ"
WESTERN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
#: A character for which the two engines' classes may differ.
UNUSUAL = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ɏ‐-‧‰-⁞€]")
#: The same among the characters of code page 1252, as bytes: superscript digits, fractions, control separators.
DOUBTFUL = [bytes([b]) for b in (0x1C, 0x1D, 0x1E, 0x1F, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE)]
#: Remembered pre-tokens per worker.
REMEMBER = 500_000


#: Bits of a pre-token's value: hash, then look (see ``look``), then length, then count.
LOOK, LENGTH, COUNT = 32, 40, 48
#: Length that stands for itself and any greater one.
LONGEST = 255
WHITE, BREAK, BREAKS, HASH, SPACED, CLAUSE_END, SENTENCE_END = (1 << i for i in range(7))


def look(word: str) -> int:
    """What a pre-token tells about boundaries, as bits."""
    if word.isspace():
        n = word.count("\n")
        return WHITE | (BREAK if n == 1 else 0) | (BREAKS if n > 1 else 0)
    end = word[-1]
    return (HASH if word[0] == "#" else 0) | (SPACED if word[0] == " " else 0) | (CLAUSE_END if end in ",;:)" else 0) | (SENTENCE_END if end in ".!?" else 0)


class Tokens(dict):
    """Pre-token -> its value, filled as needed and emptied when it has grown too large."""

    def __init__(self, path: str = TOKENIZER):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = regex.compile(PATTERN)
        self.counts = Counts(self.encoding)

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBER:
            self.clear()
        value = zlib.crc32(word.encode("utf-8", "surrogatepass")) | look(word) << LOOK | min(len(word), LONGEST) << LENGTH | min(self.counts[word], 32767) << COUNT
        self[word] = value
        return value

    def split(self, text: str) -> list[str]:
        try:
            raw = text.encode("cp1252")
        except UnicodeEncodeError:
            return (self.slow if UNUSUAL.search(text) else FAST).findall(text)
        return (self.slow if any(c in raw for c in DOUBTFUL) else WESTERN).findall(text)

    def count(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.split(text)))


class Counts(dict):
    """Pre-token -> count of tokens."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBER:
            self.clear()
        self[word] = n = len(self.encoding.encode_ordinary(word.encode("utf-8", "replace").decode("utf-8")))
        return n


_loaded: dict[str, Tokens] = {}


def tokens(path: str = TOKENIZER) -> Tokens:
    """This worker's tokenizer."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) for every row; a null text has 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(tokenizer)
        for b in batches:
            n = [t.count(x) if x else 0 for x in values(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, n_tokens bigint")
