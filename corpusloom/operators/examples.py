"""Label repair and the explosion of rows into training examples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.relational import hash_bucket, running_place

# Fixed values of the example formats.
DIRECTIONS = {"br-pt": "<BR2PT>", "pt-br": "<PT2BR>"}
LABEL_IDS = {"pt-BR": 0, "pt-PT": 1, "equal": 2}
CHAT_SYSTEM = "You translate between Brazilian and European Portuguese."
TASK_MODES = {"multitask": (True, True), "translation": (True, False), "classification": (False, True)}
_TRANSLATOR = "És um assistente especialista em português europeu e português do Brasil. A tua tarefa é converter frases entre as duas variantes, mantendo o significado, o registo e um estilo natural."
_LINGUIST = "És um linguista especializado em português europeu e português do Brasil. A tua tarefa é identificar a variante de português de uma frase."
#: System message and beginning of the user's, by task.
TASK_PROMPTS = {
    "translate_br2pt": (_TRANSLATOR, "Converte o seguinte texto de português do Brasil para português europeu, mantendo o sentido e soando natural em português europeu.\n\nTexto: "),
    "translate_pt2br": (_TRANSLATOR, "Converte o seguinte texto de português europeu para português do Brasil, mantendo o sentido e soando natural em português do Brasil.\n\nTexto: "),
    "classify": (_LINGUIST, "Qual é a variante de português desta frase? Responde apenas com \"Português do Brasil\" ou \"Português Europeu\".\n\nFrase: "),
}


def repaired_label(raw: Column, aliases: dict[str, str]) -> Column:
    """The label that an alias stands for, whatever its case and the blanks around it; other labels stay as they are."""
    out = F.lit(None).cast("string")
    key = F.lower(F.trim(raw))
    for alias, label in aliases.items():
        out = F.when(key == alias, F.lit(label)).otherwise(out)
    return F.coalesce(out, raw)


def first_filled(*texts: Column) -> Column:
    """The first text that isn't blank, as it stands."""
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts])


def variety_label(raw: Column) -> Column:
    """Answers of a classifier: ``equal`` before the two varieties, names of countries included, else null."""
    x = F.lower(raw)
    return F.when(x.contains("equal"), "equal").when(x.contains("pt-br") | x.contains("brasil"), "pt-BR").when(x.contains("pt-pt") | x.contains("europeu") | x.contains("portugal"), "pt-PT")


def _filled(c: Column) -> Column:
    return F.length(T.squeeze(F.coalesce(c, F.lit("")))) > 0


def translation_examples(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Two examples, one a direction, of every row with both sides."""
    made = F.inline(
        F.array(
            *[
                F.struct(F.lit(name).alias("direction"), F.concat(F.lit(f"<{name}> "), F.col(x)).alias("input_text"), F.col(y).alias("target_text"))
                for name, x, y in (("br-pt", a, b), ("pt-br", b, a))
            ]
        )
    )
    return df.where((F.trim(F.coalesce(a, F.lit(""))) != "") & (F.trim(F.coalesce(b, F.lit(""))) != "")).select(F.col(key).alias("source_id"), made)


def classification_examples(df: DataFrame, key: str, a: str, b: str, label: str) -> DataFrame:
    """A given label wins, with the first filled side; two sides alike are one ``equal``; else each filled side has its variety."""
    has_a, has_b = _filled(F.col(a)), _filled(F.col(b))
    alike = has_a & has_b & (T.squeeze(F.col(a)) == T.squeeze(F.col(b)))
    one = lambda test, text, name: F.when(test, F.struct(text.alias("text"), name.alias("label")))
    given = F.col(label).isNotNull()
    made = F.array(
        one(given & (has_a | has_b), F.when(has_a, F.col(a)).otherwise(F.col(b)), F.col(label)),
        one(~given & alike, F.col(a), F.lit("equal")),
        one(~given & has_a & ~alike, F.col(a), F.lit("pt-BR")),
        one(~given & has_b & ~alike, F.col(b), F.lit("pt-PT")),
    )
    out = df.select(F.col(key).alias("source_id"), F.inline(F.filter(made, lambda x: x.isNotNull())))
    ids = F.create_map(*[F.lit(x) for pair in LABEL_IDS.items() for x in pair])
    return out.select("source_id", F.concat(F.lit("<id> "), "text").alias("input_text"), "label", ids[F.col("label")].alias("label_id"))


def chat_examples(df: DataFrame, key: str, a: str, b: str, seed: int, back_share: int = 7000) -> DataFrame:
    """One direction a row, chosen by a seeded hash of its key."""
    back = hash_bucket([F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))], 10_000) < back_share
    kept = df.where((F.trim(F.coalesce(a, F.lit(""))) != "") & (F.trim(F.coalesce(b, F.lit(""))) != ""))
    return kept.select(F.col(key).alias("source_id"), F.when(back, "pt-br").otherwise("br-pt").alias("direction"), F.when(back, F.col(b)).otherwise(F.col(a)).alias("user_text"), F.when(back, F.col(a)).otherwise(F.col(b)).alias("assistant_text"))


def chat_messages(examples: DataFrame) -> DataFrame:
    """The nested form: system, user and assistant messages."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return examples.select("source_id", F.array(message("system", F.lit(CHAT_SYSTEM)), message("user", F.col("user_text")), message("assistant", F.col("assistant_text"))).alias("messages"))


def _wanted(task_mode: str) -> tuple[Column, Column]:
    if task_mode not in TASK_MODES:
        raise ValueError(f"task_mode is one of {', '.join(TASK_MODES)}")
    translation, classification = TASK_MODES[task_mode]
    return F.lit(translation), F.lit(classification)


def _clean(c: str) -> Column:
    """Stripped; null if nothing is left."""
    return F.nullif(T.strip(F.col(c).cast("string")), F.lit(""))


def dataset_chat_examples(df: DataFrame, key: str, seed: int, task_mode: str = "multitask", back_share: int = 7000, variety_tags: tuple[str, ...] = ("PtBrVarId", "PtBrVId")) -> DataFrame:
    """Examples of unified rows by the rule of their dataset and the task mode: ``source_id``, ``dataset``, ``task``, ``source``, ``target``.

    The variety corpus gives its label with the first filled side and no translation.  Other rows with both sides give one translation, its
    direction by a seeded hash of the key, and each filled side gives its variety; of OpenSubs only rows with both sides do.
    """
    translation, classification = _wanted(task_mode)
    back = hash_bucket([F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))], 10_000) < back_share
    br, pt, label, dataset = F.col("__br"), F.col("__pt"), F.col("__label"), F.coalesce("dataset", F.lit(""))
    has_br, has_pt = br.isNotNull(), pt.isNotNull()
    variety, subtitles = dataset.isin(*variety_tags), dataset == "OpenSubs"
    both, sides = ~variety & has_br & has_pt, ~variety & (~subtitles | (has_br & has_pt))
    made = F.array(
        _example(translation & both & back, "translate_pt2br", pt, br),
        _example(translation & both & ~back, "translate_br2pt", br, pt),
        _example(classification & sides & has_br, "classify", br, F.lit("pt-BR")),
        _example(classification & sides & has_pt, "classify", pt, F.lit("pt-PT")),
        _example(classification & variety & label.isin("pt-BR", "pt-PT") & (has_br | has_pt), "classify", F.coalesce(br, pt), label),
    )
    clean = df.select(F.col(key), "dataset", _clean("text_pt_br").alias("__br"), _clean("text_pt_pt").alias("__pt"), _clean("label").alias("__label"))
    return clean.select(F.col(key).alias("source_id"), "dataset", F.inline(F.array_compact(made))).drop("ref_kind")


def _unprefixed(text: str, given: str) -> Column:
    """The text, or else the input without the task's prefix; null if both are blank."""
    return F.coalesce(_clean(text), F.nullif(F.regexp_replace(T.strip(F.col(given)), r"^<[^>]+>\s*", ""), F.lit("")))


def task_verdicts(translations: DataFrame, classifications: DataFrame, key: str, task_mode: str = "multitask") -> DataFrame:
    """Every row of the two task files that the mode reads: ``source_id``, ``task``, ``source``, ``target``, ``verdict``.

    Translations have ``source_text``, ``input_text``, ``target_text`` and ``direction`` (else the input's prefix tells); classifications ``text``,
    ``input_text`` and ``label``.  The verdict is ``example``, ``skipped`` (something is missing) or ``skipped_equal`` (a text whose label is no variety).
    """
    translation, classification = _wanted(task_mode)
    said, given = F.lower(T.strip(F.coalesce("direction", F.lit("")))), T.strip(F.col("input_text"))
    way = F.when(said != "", said).when(given.startswith("<br-pt>"), "br2pt").when(given.startswith("<pt-br>"), "pt2br")
    t = translations.where(translation).select(F.col(key).alias("source_id"), F.when(way.isin("br2pt", "pt2br"), F.concat(F.lit("translate_"), way)).alias("task"), _unprefixed("source_text", "input_text").alias("source"), _clean("target_text").alias("target"))
    t = t.withColumn("verdict", F.when(F.col("task").isNotNull() & F.col("source").isNotNull() & F.col("target").isNotNull(), "example").otherwise("skipped"))
    name = F.lower(_clean("label"))
    c = classifications.where(classification).select(F.col(key).alias("source_id"), F.lit("classify").alias("task"), _unprefixed("text", "input_text").alias("source"), F.when(name == "pt-br", "pt-BR").when(name == "pt-pt", "pt-PT").alias("target"))
    c = c.withColumn("verdict", F.when(F.col("source").isNull(), "skipped").when(F.col("target").isNull(), "skipped_equal").otherwise("example"))
    return t.unionByName(c)


def task_examples(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("verdict = 'example'").select("source_id", F.lit("GPT").alias("dataset"), "task", "source", "target")


def task_counts(verdicts: DataFrame) -> DataFrame:
    """Rows read, examples, examples of each task and texts skipped for their label."""
    made = F.col("verdict") == "example"
    return verdicts.agg(F.count("*").alias("rows"), F.count_if(made).alias("examples"), *[F.count_if(made & (F.col("task") == t)).alias(t) for t in TASK_PROMPTS], F.count_if(F.col("verdict") == "skipped_equal").alias("skipped_equal"))


def task_messages(examples: DataFrame) -> DataFrame:
    """The nested form of examples of any task: system, user and assistant messages."""
    prompt = lambda k: F.create_map(*[F.lit(x) for t, p in TASK_PROMPTS.items() for x in (t, p[k])])[F.col("task")]
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return examples.select("source_id", F.array(message("system", prompt(0)), message("user", F.concat(prompt(1), "source")), message("assistant", F.col("target"))).alias("messages"))


def multitask(examples: DataFrame) -> DataFrame:
    """Encoder prefix to decoder token; ``valid`` tells whether the prefix is known."""
    prefix = F.regexp_extract("input_text", r"^<([^>]*)>", 1)
    names = F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair])
    token = names[prefix]
    return examples.select("source_id", F.regexp_replace("input_text", r"^<[^>]*>\s*", "").alias("encoder_text"), F.concat_ws(" ", token, "target_text").alias("decoder_text"), token.isNotNull().alias("valid"))


def parallel_lines(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``idx`` (0-based place in order of key) and a line of each side."""
    placed = running_place(df, key, "idx")
    return placed.select("idx", F.col(key), T.one_line(F.col(a)).alias(f"{a}_line"), T.one_line(F.col(b)).alias(f"{b}_line"))


def prompt(template: str, **parts: Column) -> Column:
    """A template whose ``{name}`` places are filled with columns; other signs, braces that name nothing among them, stay as they are."""
    pieces, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m[1] in parts:
            pieces += [F.lit(template[at : m.start()]), parts[m[1]]]
            at = m.end()
    return F.concat(*pieces, F.lit(template[at:]))


def _example(test: Column, task: str, source: Column, target: Column, kind: str | None = None) -> Column:
    return F.when(test, F.struct(F.lit(task).alias("task"), source.alias("source"), target.alias("target"), F.lit(kind).cast("string").alias("ref_kind")))


def evaluation_examples(df: DataFrame, key: str, variety_tags: tuple[str, ...] = ("PtBrVarId", "PtBrVId")) -> DataFrame:
    """Examples of unified rows by the rule of their dataset.

    The variety corpus gives its label with the first filled side; gold rows one translation a reference; other rows translations both
    ways if both sides are filled, and each filled side's variety.
    """
    col = F.col
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    br, pt = col("text_pt_br"), col("text_pt_pt")
    variety, gold = col("dataset").isin(*variety_tags), col("dataset") == "Gold"
    plain = ~variety & ~gold
    both = plain & has(br) & has(pt)
    made = F.array(
        _example(both, "translate_br2pt", br, pt),
        _example(both, "translate_pt2br", pt, br),
        _example(plain & has(br), "classify", br, F.lit("pt-BR")),
        _example(plain & has(pt), "classify", pt, F.lit("pt-PT")),
        _example(variety & col("label").isin("pt-BR", "pt-PT") & (has(br) | has(pt)), "classify", F.when(has(br), br).otherwise(pt), col("label")),
        _example(gold & has(br) & has(col("ref_pt_pt_manual")), "translate_br2pt", br, col("ref_pt_pt_manual"), "manual"),
        _example(gold & has(br) & has(col("ref_pt_pt_deepl")), "translate_br2pt", br, col("ref_pt_pt_deepl"), "deepl"),
    )
    return df.select(key, "dataset", F.coalesce(blank(col("bucket")), F.lit("UNKNOWN")).alias("bucket"), F.inline(F.array_compact(made)))


def blank(c: Column) -> Column:
    """Null for a blank text, else the text."""
    return F.when(F.trim(c) != "", c)


def resolved_task(task: Column, given: Column, target: Column) -> Column:
    """Struct of ``token``, ``input`` and ``gold``: by the task's name, else the target's token, else the input's prefix; null if none tells."""
    name, source, gold = F.trim(F.coalesce(task, F.lit(""))), F.trim(F.coalesce(given, F.lit(""))), F.trim(F.coalesce(target, F.lit("")))
    bare = F.regexp_replace(gold, r"^<(?:BR2PT|PT2BR|CLS)>\s*", "")
    out = lambda token, text, answer: F.struct(F.lit(token).alias("token"), text.alias("input"), answer.alias("gold"))
    found = F.lit(None)
    for prefix, token in reversed(DIRECTIONS.items()):
        found = F.when(source.startswith(f"<{prefix}>"), out(token, F.regexp_replace(source, rf"^<{prefix}>\s*", ""), gold)).otherwise(found)
    for token in reversed(DIRECTIONS.values()):
        found = F.when(gold.startswith(token), out(token, source, bare)).otherwise(found)
    for names, token in reversed(((("translate_br2pt", "<BR2PT>"), "<BR2PT>"), (("translate_pt2br", "<PT2BR>"), "<PT2BR>"))):
        found = F.when(name.isin(*names), out(token, source, bare)).otherwise(found)
    return found


def target_format(target: Column) -> Column:
    """``translation``, ``classification`` or ``bad``: a known token first, and for a class exactly one known label behind it."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(target, F.lit("")), r"\s+", " ")), " ")
    head = F.get(words, F.lit(0))
    labelled = (F.size(words) == 2) & F.get(words, F.lit(1)).isin("pt-br", "pt-pt", "equal")
    return F.when(head.isin(*DIRECTIONS.values()), "translation").when((head == "<CLS>") & labelled, "classification").otherwise("bad")
