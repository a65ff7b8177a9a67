"""Token-id expressions shared by the block, model and report operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special token ids, the ignore label of masked targets, the
# block (context) length and the offset of the character tokenizer.
PAD_ID = 0
BOS_ID = 1
EOS_ID = 2
UNK_ID = 3
SPECIAL_TOKENS = ("<pad>", "<bos>", "<eos>", "<unk>")
IGNORE_ID = -100
BLOCK_LEN = 64
CHAR_ID_OFFSET = 4


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def char_ids(text) -> Column:
    """Character tokenizer: one id per code point, id = 4 + code point.

    ``(?s).`` matches a whole code point (surrogate pairs included), so this
    agrees with Python's iteration over a string. Empty or NULL text -> [].
    """
    chars = F.regexp_extract_all(_col(text), F.lit("(?s)."), F.lit(0))
    return F.coalesce(F.transform(chars, lambda c: F.ascii(c) + F.lit(CHAR_ID_OFFSET)),
                      F.array().cast("array<int>"))
