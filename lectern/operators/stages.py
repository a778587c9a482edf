"""Model stages: gate by filter, one call per distinct key, write before use, join back."""

from __future__ import annotations

import difflib
import re
import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import speakable as S
from lectern.functions.language import display_name
from lectern.operators import providers
from lectern.session import ship

Make = Callable[[], providers.TextProvider]


def answers(rows: DataFrame, key: str, prompt: str, make: Make, attempts: int = 1, good: Callable[[str], bool] = bool, code: str | None = None) -> DataFrame:
    """(key, answer, error): up to `attempts` calls per row until an answer is good.  With
    `code`, the column of what an answer must not repeat, it is good if it is no echo; if
    all are echoes there is an error and no answer.

    Rows should hold each key once.  A failed call gives an error and no answer; the
    provider is made once per task.  Write the result before it is used twice.
    """
    ship(rows.sparkSession)

    def run(frames):
        provider = make()
        for f in frames:
            said, errors = [], []
            for p, c in zip(f[prompt], f[code] if code else f[prompt]):
                answer = error = None
                for _ in range(attempts):
                    try:
                        answer, error = provider.generate(p), None
                    except Exception as e:  # isolated: one row's failure is its own
                        answer, error = None, f"{type(e).__name__}: {e}"
                        break
                    if not is_echo(c, answer) if code else good(answer):
                        break
                else:
                    if code:
                        answer, error = None, "echo"
                said.append(answer), errors.append(error)
            yield pd.DataFrame({key: f[key], "answer": said, "error": errors})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, prompt, *([code] if code else [])).mapInPandas(run, f"{key} {kind}, answer string, error string")


def is_echo(code: str | None, reply: str | None) -> bool:
    """scalars.is_echo of one answer."""
    flat, said = " ".join((code or "").split()), " ".join((reply or "").split())
    lines = (" ".join(x.split()) for x in (code or "").splitlines())
    return len(flat) >= 8 and flat in said or any(len(x) >= 16 and x in said for x in lines)


def sanitize(blocks: DataFrame, make: Make, write: Callable[[DataFrame], DataFrame], language: str = "it", key: str = "key", text: str = "text", previous: str | None = None) -> DataFrame:
    """(key, speech_text): two rounds with the model for text that needs it, then the strip.

    Blank text is silent; speakable text passes; a failing call or an unspeakable second
    answer is stripped.  An empty answer is silence.  The model is told the text before
    (`previous`, a column) and what the gate found.
    """
    before = F.coalesce(F.col(previous), F.lit("")) if previous else F.lit("")
    clean = blocks.select(key, before.alias("before"), S.remove_invisible(F.col(text)).alias("t")).withColumn("blank", F.trim("t") == "")
    # the gate is dear: what it said is written, not worked out again wherever it is asked
    clean, gate = write(clean.withColumn("gate", F.coalesce(S.needs_model(F.col("t"), language), F.lit(False)))), F.col("gate")
    passed = clean.filter(F.col("blank") | ~gate).select(key, F.when(F.col("blank"), "").otherwise(F.col("t")).alias("speech_text"))
    todo, out = clean.filter(~F.col("blank") & gate).select(key, "before", "t"), [passed]
    for turn in (1, 2):
        head = F.lit(f"STAGE: sanitize {turn}\nLANGUAGE: {display_name(language)}\nPREVIOUS: ")
        asked = todo.withColumn("prompt", F.concat(head, "before", F.lit("\nLEFTOVER: "), S.describe_unspeakable(F.col("t"), language), F.lit("\n\nTEXT:\n"), "t"))
        got = write(todo.join(answers(asked, key, "prompt", make), key))
        failed = got.filter("error IS NOT NULL")
        out.append(failed.select(key, S.strip_unspeakable(F.col("t"), language).alias("speech_text")))
        told = got.filter("error IS NULL").select(key, "before", S.remove_invisible(F.col("answer")).alias("t"))
        told = write(told.withColumn("dirty", F.coalesce(S.needs_model(F.col("t"), language), F.lit(False))))
        out.append(told.filter("NOT dirty").select(key, F.trim("t").alias("speech_text")))
        todo = told.filter("dirty").drop("dirty")
    out.append(todo.select(key, S.strip_unspeakable(F.col("t"), language).alias("speech_text")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return whole


def translate(blocks: DataFrame, make: Make, key: str = "key", text: str = "text") -> DataFrame:
    """(key, translated_text) of blocks with text and no translation: up to three calls
    while the answer is empty, then silence; errors are kept for the caller."""
    asked = blocks.filter((F.col(text) != "") & F.col("translated_text").isNull()).withColumn("prompt", F.concat(F.lit("STAGE: translate\n\nTEXT:\n"), text))
    got = answers(asked, key, "prompt", make, attempts=3, good=lambda a: bool(a and a.strip()))
    return got.select(key, F.when(F.col("error").isNull(), F.coalesce(F.trim("answer"), F.lit(""))).alias("translated_text"), "error")


def describe(rows: DataFrame, cache: DataFrame, make: Make, write: Callable[[DataFrame], DataFrame], key: str = "key", code: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(descriptions by key, rows to append to the cache).  One call per key that the cache
    lacks; declined and failed ones are null and never cached.  With `code`, the column of described
    code, an answer that repeats it is asked for once more and then counts as failed."""
    todo = rows.select(key, "prompt", *([code] if code else [])).dropDuplicates([key]).join(cache.select(key), key, "left_anti")
    got = write(answers(todo, key, "prompt", make, attempts=2 if code else 1, code=code))
    made = got.filter("error IS NULL AND trim(answer) <> ''").select(key, F.trim("answer").alias("description"))
    return cache.select(key, "description").union(made), made


# --- speech quality

_MARKS = str.maketrans("", "", string.punctuation)


def normal_words(text: str) -> list[str]:
    return text.lower().translate(_MARKS).split()


def word_error_rate(said: str | None, heard: str | None) -> float | None:
    """Word edits over the words said; null for null; 0 or 1 where nothing was said."""
    if said is None or heard is None:
        return None
    a, b = normal_words(said), normal_words(heard)
    if not a:
        return float(bool(b))
    # a column of the distance table at once: bits of `up` and `down` are its steps of one (Myers)
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, edits = whole, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        across = (((same & up) + up) ^ up) | same
        more, less = down | (whole & ~(across | up)), up & across
        edits += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & whole, less << 1 & whole
        same |= down
        up, down = less | (whole & ~(same | more)), more & same
    return edits / len(a)


def wer(said: F.Column, heard: F.Column) -> F.Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([word_error_rate(x, y) for x, y in zip(a, b)], dtype="float64")

    return run(said, heard)


def word_diff(said: str, heard: str) -> list[str]:
    return [x for x in difflib.ndiff(normal_words(said), normal_words(heard)) if not re.match(r"\?", x)]
