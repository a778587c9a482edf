"""Items to episodes: extraction, triage, descriptions, translation, sanitising, speech, audio.

Every stage adds columns or joins by key; what a model said is written before it is used
twice; an item that fails in one stage goes on in none and is reported with its error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import scalars
from lectern.functions.language import code, display_name
from lectern.operators import html_blocks, providers, relational as R, stages
from lectern.session import ship

#: Rows of a table that a model is shown, and the word error rate that is reported.
SHOWN_ROWS, HIGH_WER = 50, 0.2
Write = Callable[[DataFrame], DataFrame]
SPOKEN = ("heading", "prose", "quote", "list")


@dataclass
class Models:
    """How a worker makes each provider, and answers of earlier runs by kind: (key, ...)."""

    text: Callable[[], providers.TextProvider] = providers.Offline
    vision: Callable[[], providers.VisionProvider] = providers.Offline
    speech: Callable[[], providers.SpeechProvider] = providers.Offline
    caches: dict[str, DataFrame] = field(default_factory=dict)


def _cache(models: Models, name: str, like: DataFrame, schema: str) -> DataFrame:
    return models.caches.get(name, like.sparkSession.createDataFrame([], schema))


def _prompt(stage: str, language: str, text: F.Column, **fields: F.Column) -> F.Column:
    head = [F.lit(f"STAGE: {stage}\nLANGUAGE: {display_name(language)}\n")]
    for name, value in fields.items():
        head += [F.lit(f"{name.upper()}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\n")]
    return F.concat(*head, F.lit("\nTEXT:\n"), text)


def triage(blocks: DataFrame, models: Models, write: Write, language: str = "it") -> tuple[DataFrame, DataFrame]:
    """(blocks with dropped, deictic, truncated_at and play_pos; verdicts to keep).  One call
    per item; a failed one leaves its item as it is and is not kept."""
    said = scalars.excerpt(F.col("kind"), F.col("text"), F.coalesce(F.nullif(F.col("visual.caption"), F.lit("")), F.col("visual.alt")), F.col("rows"))
    lines = R.outline(blocks.select("item_id", "idx", "kind", said.alias("excerpt")))
    sizes = blocks.groupBy("item_id").agg((F.max("idx") + 1).alias("size"))
    held = _cache(models, "triage", blocks, f"item_id {dict(blocks.dtypes)['item_id']}, answer string")
    asked = lines.join(held.select("item_id"), "item_id", "left_anti").select("item_id", _prompt("triage", language, F.col("outline")).alias("prompt"))
    made = write(stages.answers(asked, "item_id", "prompt", models.text)).filter("error IS NULL").select("item_id", "answer")
    verdicts = held.select("item_id", "answer").union(made).join(sizes, "item_id").select("item_id", R.parse_verdict(F.col("answer"), F.col("size")).alias("verdict"))
    return R.reposition(R.apply_verdict(blocks, verdicts)), made


def describe_visuals(blocks: DataFrame, models: Models, write: Write, language: str = "it") -> tuple[DataFrame, DataFrame]:
    """(item_id, vid, klass, description), and answers to keep by vid.  A leading picture and
    vector graphics are decorative without a call; so is, for this run alone, what fails."""
    seen = html_blocks.visuals(blocks.filter(~F.coalesce(F.col("dropped"), F.lit(False))))
    vector = F.lower(F.regexp_replace("fetch_url", r"[?#].*$", "")).endswith(".svg")
    held = _cache(models, "visual", blocks, "vid string, klass string, description string")
    todo = seen.filter(~F.col("hero") & ~vector).dropDuplicates(["vid"]).join(held.select("vid"), "vid", "left_anti")
    ship(blocks.sparkSession)
    make = models.vision

    def run(frames):
        provider = make()
        for f in frames:
            said = []
            for prompt, url in zip(f["prompt"], f["fetch_url"]):
                try:
                    said.append(provider.look(prompt, url))
                except Exception:  # one picture's failure is its own
                    said.append(None)
            yield pd.DataFrame({"vid": f["vid"], "answer": said}, dtype="object")

    asked = todo.select("vid", "fetch_url", _prompt("visual", language, F.lit(""), hint=F.col("hint"), alt=F.col("alt"), caption=F.col("caption")).alias("prompt"))
    told = F.from_json(F.regexp_extract("answer", r"(?s)\{.*\}", 0), "klass string, description string")
    got = write(asked.mapInPandas(run, "vid string, answer string")).select("vid", told.alias("a")).filter("a IS NOT NULL AND (a.klass IS NOT NULL OR a.description IS NOT NULL)")
    made = got.select("vid", scalars.visual_class(F.col("a.klass")).alias("klass"), F.nullif(F.trim("a.description"), F.lit("")).alias("description"))
    known = held.select("vid", scalars.visual_class(F.col("klass")).alias("klass"), "description").union(made)
    out = seen.select("item_id", "vid", F.col("hero").alias("h")).join(known, "vid", "left")
    klass = F.when(F.col("h") | F.col("klass").isNull(), "decorative").otherwise(F.col("klass"))
    return out.select("item_id", "vid", klass.alias("klass"), F.when(~F.col("h"), F.col("description")).alias("description")), made


def describe_tables(blocks: DataFrame, models: Models, write: Write, language: str = "it") -> tuple[DataFrame, DataFrame]:
    """(item_id, idx, description) of tables, and descriptions to keep by content.  The model
    sees SHOWN_ROWS rows and whether there are more; what it declines is read out flat."""
    grids = blocks.filter("kind = 'table' AND NOT coalesce(dropped, false)").select("item_id", "idx", "rows", scalars.stable_id(F.to_json("rows")).alias("key"))
    shown = _prompt("table", language, scalars.render_rows(F.slice("rows", 1, SHOWN_ROWS)), truncated=F.size("rows") > SHOWN_ROWS)
    told, made = stages.describe(grids.withColumn("prompt", shown), _cache(models, "table", blocks, "key string, description string"), models.text, write)
    said = F.coalesce(F.nullif("description", F.lit("")), scalars.flatten_rows(F.col("rows")))
    return grids.join(told, "key", "left").select("item_id", "idx", said.alias("description")), made


def describe_code(blocks: DataFrame, models: Models, write: Write, language: str = "it") -> tuple[DataFrame, DataFrame]:
    """(item_id, idx, description) of code, and descriptions to keep by content.  An answer
    that repeats the code is asked for once more; then there is none."""
    own = blocks.filter("kind = 'code' AND NOT coalesce(dropped, false)").select("item_id", "idx", F.col("text").alias("code"), "lang", scalars.stable_id(F.col("text")).alias("key"))
    asked = own.withColumn("prompt", _prompt("code", language, F.col("code"), lang=F.col("lang")))
    told, made = stages.describe(asked, _cache(models, "code", blocks, "key string, description string"), models.text, write, code="code")
    return own.join(told, "key", "left").select("item_id", "idx", "description"), made


def speak(blocks: DataFrame, models: Models, language: str = "it") -> DataFrame:
    """(key, audio, heard, wer, error) of texts (key, text): made, heard again, compared.  A
    high word error rate is reported and the audio kept."""
    ship(blocks.sparkSession)
    make, spoken = models.speech, code(language)

    def run(frames):
        provider = make()
        for f in frames:
            out = []
            for text in f["text"]:
                try:
                    audio = provider.speak(text)
                    heard = provider.transcribe(audio)
                    out.append((audio, heard, stages.word_error_rate(text, heard), None))
                except Exception as e:  # the item's failure
                    out.append((None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame([(k, *row) for k, row in zip(f["key"], out)], columns=["key", "audio", "heard", "wer", "error"])

    return blocks.select("key", "text").mapInPandas(run, "key string, audio binary, heard string, wer double, error string").withColumn("language", F.lit(spoken))


def _failures(rows: DataFrame, stage: str) -> DataFrame:
    return rows.filter("error IS NOT NULL").groupBy("item_id").agg(F.min("error").alias("error")).select("item_id", F.lit(stage).alias("stage"), "error")


def process_items(items: DataFrame, models: Models, write: Write, language: str = "it") -> tuple[DataFrame, DataFrame]:
    """Items (item_id, html) to (episodes, made).

    episodes: (item_id, ok, audio, n_blocks, worst_wer, stage, error), one row per item; ok
    rows alone may be marked seen.  made: what the models said, by kind, to be appended to
    the caches.  Blocks play in play_pos order; text of dropped blocks is never asked about.
    """
    read = write(html_blocks.extract_blocks(items, "item_id", "html", quarantine=True))
    failed = [_failures(read, "extract")]
    blocks, made = read.filter("error IS NULL").drop("error"), {}
    blocks, made["triage"] = triage(blocks, models, write, language)
    blocks = write(blocks)
    figures, made["visual"] = describe_visuals(blocks, models, write, language)
    grids, made["table"] = describe_tables(blocks, models, write, language)
    codes, made["code"] = describe_code(blocks, models, write, language)
    told = blocks.join(grids.union(codes), ["item_id", "idx"], "left").withColumn("translated_text", F.lit(None).cast("string"))
    told = R.attach_descriptions(told, figures).select("item_id", "idx", "play_pos", "kind", "text", "dropped", "translated_text")
    told = write(told.withColumn("key", F.sha2(F.concat_ws("|", F.lit(language), "kind", "text"), 256)))

    own = told.filter(F.col("kind").isin(*SPOKEN) & ~F.coalesce("dropped", F.lit(False)) & (F.col("text") != ""))
    held = _cache(models, "text", blocks, "key string, translated_text string")
    asked = own.select("key", "text").dropDuplicates(["key"]).join(held.select("key"), "key", "left_anti").withColumn("translated_text", F.lit(None).cast("string"))
    said = write(stages.translate(asked, models.text))
    made["text"] = said.filter("error IS NULL").select("key", "translated_text")
    failed.append(_failures(own.join(said.select("key", "error"), "key"), "translate"))
    known = held.select("key", F.col("translated_text").alias("said")).union(made["text"])
    whole = told.join(known, "key", "left").withColumn("translated_text", F.coalesce("translated_text", "said")).filter("translated_text <> ''")

    lines = R.previous_text(whole, "item_id", "idx", "translated_text").withColumn("key", F.sha2(F.concat_ws("|", F.lit(language), "previous", "translated_text"), 256))
    lines = write(lines.select("item_id", "idx", "play_pos", "key", "previous", "translated_text"))
    held = _cache(models, "speech", blocks, "key string, speech_text string")
    todo = lines.dropDuplicates(["key"]).join(held.select("key"), "key", "left_anti")
    made["speech"] = write(stages.sanitize(todo, models.text, write, language, "key", "translated_text", "previous"))
    clean = lines.join(held.select("key", "speech_text").union(made["speech"]), "key").filter("speech_text <> ''")
    clean = clean.select("item_id", "idx", "play_pos", F.sha2(F.concat_ws("|", F.lit(language), "speech_text"), 256).alias("key"), F.col("speech_text").alias("text"))

    held = _cache(models, "audio", blocks, "key string, audio binary, wer double")
    voiced = write(speak(clean.select("key", "text").dropDuplicates(["key"]).join(held.select("key"), "key", "left_anti"), models, language))
    made["audio"] = voiced.filter("error IS NULL").select("key", "audio", "wer")
    failed.append(_failures(clean.join(voiced.select("key", "error"), "key"), "speech"))
    sound = clean.join(held.select("key", "audio", "wer").union(made["audio"]), "key")
    audio = R.ordered_bytes(sound, "item_id", "play_pos", "audio")
    facts = sound.groupBy("item_id").agg(F.count("*").alias("n_blocks"), F.max("wer").alias("worst_wer"))
    wrong = failed[0].union(failed[1]).union(failed[2]).groupBy("item_id").agg(F.min(F.struct("stage", "error")).alias("wrong"))
    out = items.select("item_id").join(wrong, "item_id", "left").join(audio, "item_id", "left").join(facts, "item_id", "left")
    ok = F.col("wrong").isNull()
    return out.select("item_id", ok.alias("ok"), F.when(ok, F.coalesce("audio", F.lit(b""))).alias("audio"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), "worst_wer", "wrong.stage", "wrong.error"), made
