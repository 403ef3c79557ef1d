"""English stop words: Spark's own list, adjusted to the 318-word list common in text classification."""

from __future__ import annotations

import zipfile
from pathlib import Path

import pyspark
from pyspark import SparkContext
from pyspark.ml.feature import StopWordsRemover

# Words added to Spark's default English list.
ADDED = """
across afterwards almost alone along already also although always among amongst amoungst amount another anyhow
anyone anything anyway anywhere around back became become becomes becoming beforehand behind beside besides
beyond bill bottom call cant co con couldnt cry de describe detail done due eg eight either eleven else
elsewhere empty enough etc even ever every everyone everything everywhere except fifteen fifty fill find fire
first five former formerly forty found four front full get give go hasnt hence hereafter hereby herein hereupon
however hundred ie inc indeed interest keep last latter latterly least less ltd made many may meanwhile might
mill mine moreover mostly move much must name namely neither never nevertheless next nine nobody none noone
nothing nowhere often one onto others otherwise part per perhaps please put rather re see seem seemed seeming
seems serious several show side since sincere six sixty somehow someone something sometime sometimes somewhere
still system take ten thence thereafter thereby therefore therein thereupon thick thin third though three
throughout thru thus together top toward towards twelve twenty two un upon us via well whatever whence whenever
whereafter whereas whereby wherein whereupon wherever whether whither whoever whole whose within without yet
""".split()

# Words of Spark's list that stay in the text.
KEPT = ["did", "does", "doing", "don", "having", "just", "ought", "s", "t", "theirs"]


def _spark_words() -> list[str]:
    """Spark's default list; without a running session it is read from the jar that PySpark ships."""
    if SparkContext._active_spark_context is not None:
        return list(StopWordsRemover.loadDefaultStopWords("english"))
    jar = next((Path(pyspark.__file__).parent / "jars").glob("spark-mllib_*.jar"))
    with zipfile.ZipFile(jar) as z:
        return z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split("\n")


def english_stop_words() -> list[str]:
    base = {w.strip() for w in _spark_words() if w.strip() and "'" not in w}
    return sorted((base - set(KEPT)) | set(ADDED))
