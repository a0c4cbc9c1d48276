"""Tokens and their Shannon entropy."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.lets import let
from credsieve.functions.spans import find_spans

# What separates tokens, and the two alphabets secrets are written in.
TOKEN_BREAKS = r"""\t\n\x0B\f\r\x1C\x1D\x1E\x1F '"`,;(){}\[\]<>\\/=:"""
WIDE_SPACES = (
    "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BASE64 = "A-Za-z0-9+/="
HEX = "0-9a-fA-F"
HEX_SIZE = 22

# log2 is not exact on the JVM; far above its error, far below any real entropy step.
SLACK = 1e-9


def tokens(content: Column, shortest: int = 1) -> Column:
    """Spans of all tokens of at least ``shortest`` characters.

    A class of single ASCII characters is many times faster on the JVM than one with all of
    Unicode's spaces, so those are first made plain spaces, which moves no offset and, as tokens
    hold none, changes no value. Lines without multi-byte characters skip even that.
    """
    is_ascii = F.octet_length(content) == F.length(content)
    plain = F.when(is_ascii, content).otherwise(
        F.translate(content, WIDE_SPACES, " " * len(WIDE_SPACES))
    )
    return let(plain, lambda p: find_spans(p, F.lit(f"[^{TOKEN_BREAKS}]{{{shortest},}}"), False))


def only(text: Column, alphabet: str) -> Column:
    return F.regexp_replace(text, f"[^{alphabet}]", "")


def shannon_entropy(text: Column, alphabet: str) -> Column:
    """Bits per character over the characters of ``text`` that are in ``alphabet``."""
    return let(only(text, alphabet), lambda kept: _entropy(kept, _letters(kept)))


def _letters(kept: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(kept, F.lit("(?s)."), 0))


def _entropy(kept: Column, letters: Column) -> Column:
    # Both alphabets are ASCII, so bytes are characters and need no counting.
    n = F.octet_length(kept)
    counts = F.transform(letters, lambda c: n - F.octet_length(F.replace(kept, c, F.lit(""))))
    weighted = F.aggregate(counts, F.lit(0.0), lambda a, k: a + k * F.log2(k))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.log2(n) - weighted / n)


def best_entropy(token: Column) -> Column:
    """Struct of the larger entropy and its alphabet; base64 wins a tie."""
    return let(
        F.struct(shannon_entropy(token, BASE64).alias("b"), shannon_entropy(token, HEX).alias("h")),
        lambda e: F.struct(
            F.greatest(e["b"], e["h"]).alias("entropy"),
            F.when(e["b"] >= e["h"] - SLACK, F.lit("base64")).otherwise(F.lit("hex")).alias("charset"),
        ),
    )


def fewest_letters(threshold: float) -> int:
    """Entropy is at most log2 of the number of distinct characters, which bounds it below."""
    return math.ceil(2 ** (threshold - SLACK))


def is_high_entropy(token: Column, threshold: float) -> Column:
    """Whether the entropy over either alphabet reaches the threshold.

    The base64 alphabet contains the hex one, so its distinct characters bound both entropies
    and most tokens are settled by counting them. No hex text has more than log2(22) bits per
    character, so above that (as by default) hex is left out.
    """
    hex_counts = threshold - SLACK <= math.log2(HEX_SIZE)

    def reaches(kept: Column, letters: Column) -> Column:
        found = _entropy(kept, letters) >= threshold - SLACK
        return found | (shannon_entropy(kept, HEX) >= threshold - SLACK) if hex_counts else found

    return let(
        only(token, BASE64),
        lambda kept: let(
            _letters(kept),
            lambda letters: F.when(
                F.size(letters) >= fewest_letters(threshold), reaches(kept, letters)
            ).otherwise(F.lit(False)),
        ),
    )
