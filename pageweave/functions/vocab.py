"""Character classes: 0 none, 1 page, 2 paragraph, 3 line, 4 word, 5 and above characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The vocabulary's ranges of code points, then its single signs, in its order. 455 characters.
RANGES = ((0x20, 0x7E), (0xA0, 0xFF), (0x100, 0x17F), (0x391, 0x3A9), (0x3B1, 0x3C9))
SIGNS = (
    "∀∂∃∅∇∈∉∋∏∑−∕∗√∝∞∠∧∨∩∪∫∬∭∴∵∼≈≠≡≤≥≪≫⊂⊃⊆⊇⊎⊑⊒⊕⊗⊢⊣⊥⋅⋆⋮⋯"
    "←↑→↓↔↕↦⇐⇑⇒⇓⇔"
    "ℏℑℓℕℙℚℝℤℬℰℱℋℐℒℳ"
    "×÷…–—‘’“”′″"
)
STRUCTURE = ("NONE", "PAGE", "PARA", "LINE", "WORD")
FIRST_CHAR = 5


def characters() -> list[str]:
    return list(dict.fromkeys([*(chr(c) for a, b in RANGES for c in range(a, b + 1)), *SIGNS]))


def vocabulary(spark: SparkSession) -> DataFrame:
    """``ch, class_id``."""
    return spark.createDataFrame([(c, FIRST_CHAR + k) for k, c in enumerate(characters())], "ch string, class_id int")


def encode_chars(chars: DataFrame, vocab: DataFrame) -> DataFrame:
    """``class_id`` of each ``ch``, 0 where it is not in the vocabulary."""
    return chars.join(vocab, "ch", "left").withColumn("class_id", F.coalesce("class_id", F.lit(0)))


def decode_class(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """``label``: the structure's name, the character as a quoted literal, or ``'?'``."""
    names = F.array(*[F.lit(x) for x in STRUCTURE])
    mark = F.when(F.col("ch") == "'", '"').otherwise("'")  # a quote stands between double quotes
    shown = F.when(F.col("ch") == "\\", "\\\\").when(F.col("ch") == "\u00a0", r"\xa0").when(F.col("ch") == "\u00ad", r"\xad").otherwise(F.col("ch"))
    quoted = F.concat(mark, shown, mark)
    named = F.when(F.col("class_id") < FIRST_CHAR, F.get(names, F.col("class_id"))).otherwise(F.coalesce(quoted, F.lit("'?'")))
    return rows.join(vocab, "class_id", "left").withColumn("label", named).drop("ch")
