"""Writing tables, JSON documents, one text per row, and reports."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str], single: bool = False) -> None:
    """CSV in a fixed column order; ``single`` only for tables known to be small."""
    out = df.select(*columns)
    (out.coalesce(1) if single else out).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_examples(examples: DataFrame, path: str) -> None:
    """A JSON line for each system and reference: class -> list of edits, characters unescaped."""
    edit = F.struct("page_id", "op", "a", "b")
    per = examples.groupBy("system", "ref", "klass").agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    per.groupBy("system", "ref").agg(F.map_from_entries(F.collect_list(F.struct("klass", "edits"))).alias("examples")).write.mode("overwrite").json(path)


def write_document(examples: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One indented JSON document, characters unescaped: "system|ref" -> class -> list of edits.

    For tables of a bounded size (a few edits a class): more than ``most`` rows are refused.
    """
    rows = examples.select("system", "ref", "klass", "page_id", "op", "a", "b").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a single document")
    out: dict[str, dict[str, list]] = {}
    for r in sorted(rows, key=lambda r: tuple(str(x) for x in r)):
        out.setdefault(f"{r['system']}|{r['ref']}", {}).setdefault(r["klass"], []).append({k: r[k] for k in ("page_id", "op", "a", "b")})
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, ensure_ascii=False, indent=2)


def write_new_texts(texts: DataFrame, path: str) -> None:
    """Append the texts that aren't there yet, partitioned by system and variant; a second run adds nothing."""
    spark = texts.sparkSession
    new = texts.select("system", "variant", "n", "text").dropDuplicates(["system", "variant", "n"])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        there = spark.read.schema("n int, text string, system string, variant string").parquet(path).select("system", "variant", "n")
        new = new.join(there, ["system", "variant", "n"], "left_anti")
    new.write.mode("append").partitionBy("system", "variant").parquet(path)


def write_text_files(texts: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """A file <path>/<system>/<variant>/image_<n>.txt for each row, on a folder that all executors share.

    Existing files stay unless ``overwrite`` is set. A file appears whole or not at all, so that a lost task may be
    repeated. Returns (system, variant, n, written).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            written = []
            for system, variant, n, text in pdf[["system", "variant", "n", "text"]].itertuples(index=False):
                folder = os.path.join(path, system, variant)
                name = os.path.join(folder, f"image_{n}.txt")
                written.append(overwrite or not os.path.exists(name))
                if written[-1]:
                    os.makedirs(folder, exist_ok=True)
                    part = f"{name}.{os.getpid()}.part"
                    with open(part, "w", encoding="utf-8") as f:
                        f.write(text or "")
                    os.replace(part, name)
            yield pdf[["system", "variant", "n"]].assign(written=written)

    return texts.where("system is not null and variant is not null and n is not null").select("system", "variant", "n", "text").mapInPandas(run, "system string, variant string, n int, written boolean")


def log_attempt(path: str, message: str) -> None:
    """Append a line to the log of attempts, on the driver."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(message.rstrip("\n") + "\n")
    print(message)


def headline(df: DataFrame, title: str, rows: int = 20) -> str:
    """A console table of the first rows of an ordered result, with its title."""
    out = f"== {title} ==\n" + df._show_string(rows, False)
    print(out)
    return out


def percent(x: Column) -> Column:
    return F.bround(x * 100, 2)


def report_text(name: Column, n_chars: Column, char: Column, n_words: Column, word: Column) -> Column:
    """A markdown report of one file: total, rate in percent, and the edits by kind with what was edited.

    ``char`` and ``word`` are arrays of edits (op, a, b).
    """
    of = lambda edits, op: F.filter(edits, lambda e: e["op"] == op)
    both = lambda e: F.concat(F.lit("("), e["a"], F.lit(" → "), e["b"], F.lit(")"))
    listed = lambda edits, show: F.array_join(F.transform(edits, show), " ")
    kind = lambda title, edits, show: F.concat(F.format_string(f"- {title} [%d]: ", F.size(edits)), listed(edits, show), F.lit("\n"))

    def part(title: str, unit: str, edits: Column, n: Column) -> Column:
        rate = F.when(n > 0, F.size(edits) / n).otherwise(0.0)
        return F.concat(
            F.format_string(f"## {title}\n\n{unit} of the reference: %d\nrate: %.2f%%\n\n", n, percent(rate)),
            kind("substitutions", of(edits, "replace"), both), kind("deletions", of(edits, "delete"), lambda e: e["a"]), kind("insertions", of(edits, "insert"), lambda e: e["b"]),
        )

    return F.concat(F.format_string("# %s\n\n", name), part("Characters", "characters", char, n_chars), F.lit("\n"), part("Words", "words", word, n_words))


def annotator_kit(picked: DataFrame, image_path: str = "image_{n}.jpg", template_path: str = "image_{n}.txt") -> DataFrame:
    """(page_id, n, difficulty, image_file, template_file, template) for a sample of pages."""
    fill = lambda p: F.replace(F.lit(p), F.lit("{n}"), F.col("n").cast("string"))
    note = F.format_string("# Page %d (%s). Keep every mark you can see, one line per line.\n", F.col("n"), F.col("difficulty"))
    return picked.select("page_id", "n", "difficulty", fill(image_path).alias("image_file"), fill(template_path).alias("template_file"), note.alias("template"))


# Fixed value: what annotators are asked to do.
INSTRUCTIONS = """# Annotator kit

1. Open each image in `images/`.
2. Write its text into the template of the same number in `templates/`, one line of the page per line.
3. Keep every vowel sign that is drawn and add none that isn't.
4. Keep hamza seats, final ya and alif maqsura, ta marbuta and ha as they are written.
5. Write `[غير واضح]` for a span that can't be read.
6. Leave spelling and wording alone, and add no comments beyond the first line.
"""


def write_kit(kit: DataFrame, images: str, path: str, most: int = 1_000) -> int:
    """Write a kit for annotators: images, templates, manifest and instructions; returns how many images were there.

    ``kit`` comes from :func:`annotator_kit`. A kit is for people: more than ``most`` pages are refused.
    """
    rows = kit.orderBy("n", "page_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pages for a kit")
    for folder in ("images", "templates"):
        os.makedirs(os.path.join(path, folder), exist_ok=True)
    found = 0
    manifest = []
    for r in rows:
        source = os.path.join(images, r["image_file"])
        if os.path.exists(source):
            shutil.copy2(source, os.path.join(path, "images", r["image_file"]))
            found += 1
        with open(os.path.join(path, "templates", r["template_file"]), "w", encoding="utf-8") as f:
            f.write(r["template"])
        manifest.append((r["page_id"], r["n"], r["difficulty"], f"images/{r['image_file']}", f"templates/{r['template_file']}"))
    pd.DataFrame(manifest, columns=["page_id", "n", "difficulty", "image_file", "template_file"]).to_csv(os.path.join(path, "manifest.csv"), index=False)
    with open(os.path.join(path, "README.md"), "w", encoding="utf-8") as f:
        f.write(INSTRUCTIONS)
    return found
