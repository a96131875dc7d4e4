"""Command line: one package to JSON, Markdown, chunks and a debug report; a folder of packages to tables of them."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstack.common import Scratch
from leafstack.config import ParserConfig
from leafstack.operators import evaluate, relations
from leafstack.plans import pipeline
from leafstack.sources import reader
from leafstack.sources.package import Options


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafstack", description="Parse office packages.")
    p.add_argument("input_path", help="a package (.pptx, .docx, .xlsx, .hwpx and kin) or a folder of them")
    for flag, what in (("json", "parsed documents"), ("md", "Markdown"), ("rag-json", "retrieval chunks"), ("debug-json", "debug reports")):
        p.add_argument(f"--output-{flag}", help=f"where to write {what}: a file, or a folder for many packages")
    p.add_argument("--golden-dir", help="folder of *.golden.json labels, whose sources are paths below the input folder")
    p.add_argument("--output-eval-json", help="where to write the evaluation against the labels")
    p.add_argument("--assets-dir", help="folder for image files")
    p.add_argument("--config-json", help="file with knobs that differ from the defaults")
    p.add_argument("--reading-order", choices=["composite", "row_clustering", "xy_cut"])
    return p


def config(args: argparse.Namespace) -> ParserConfig:
    cfg = ParserConfig()
    if args.config_json:
        with open(args.config_json, encoding="utf-8") as f:
            cfg = ParserConfig.from_json(f.read())
    return dataclasses.replace(cfg, reading_order_strategy=args.reading_order) if args.reading_order else cfg


def parsed(spark: SparkSession, path: str, cfg: ParserConfig, assets: str | None = None, strict: bool = False) -> tuple[pipeline.Parsed, reader.Frames]:
    """The whole pipeline over the packages at ``path``; related captions go to the verifier that refuses all."""
    options = Options(cfg.include_master_shapes, cfg.deduplicate_master_shapes, assets is not None, os.path.basename(assets.rstrip("/")) if assets else None)
    frames = reader.read_packages(spark, path, options, strict)
    return pipeline.parse(frames.pages, frames.elements.drop("extra"), frames.cells, cfg, relations.no_op_verifier()), frames


def save_assets(assets: DataFrame, folder: str) -> None:
    """Write image files from the tasks that hold them; the folder must be one that all executors share."""

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, os.path.basename(r["name"])), "wb") as f:
                f.write(r["data"])

    assets.select("name", "data").foreachPartition(write)


def chunk_json(chunks: DataFrame) -> DataFrame:
    """(doc_id, json): the chunks of each document as one list, metadata fields that are null left out."""
    meta = F.struct(F.col("doc_id").alias("source_path"), "page_number", "block_id", "block_kind", "element_ids", "outline_level", "parent_block_id", "section_path", "style.*")
    item = F.struct("chunk_idx", F.struct("chunk_id", "page_number", "text", meta.alias("metadata")).alias("c"))
    got = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", F.to_json(item["c"]).alias("j")))).alias("l"))
    return got.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]")).alias("json"))


def evaluation(got: pipeline.Parsed, golden_dir: str, folder: str, example: str) -> dict:
    """Summary and results of the labelled documents; ids of documents begin like ``example``, with a scheme or without."""
    scheme = example[: example.find(folder)] if folder in example else ""
    golden = evaluate.read_golden(got.pages.sparkSession, golden_dir, f"{scheme}{folder}/")
    rows = [r.asDict() for r in evaluate.golden_evaluation(golden, got.pages, got.ordered, got.relations).orderBy("doc_id").toLocalIterator()]
    done = [r for r in rows if r["status"] == "ok"]
    mean = lambda k: round(sum(r[k] for r in done) / max(len(done), 1), 4)
    return {"summary": {"num_golden_files": len(rows), "num_evaluated": len(done), "avg_kendall_tau": mean("avg_tau"), "avg_normalised_edit_distance": mean("avg_ned")}, "config": dataclasses.asdict(got.config), "results": rows}


def _one(df: DataFrame, empty: str) -> str:
    row = df.first()  # a single package is one row
    return empty if row is None else row[1]


def _pretty(text: str) -> str:
    return json.dumps(json.loads(text), ensure_ascii=False, indent=2)


def _save(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    print(f"Saved: {path}")


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    many = os.path.isdir(args.input_path)
    if not many:
        reader.find_reader(args.input_path)
    scratch = Scratch(spark)
    try:
        with scratch:
            got, frames = parsed(spark, args.input_path, config(args), args.assets_dir, strict=not many)
            if args.assets_dir:
                save_assets(frames.assets, args.assets_dir)
            if args.golden_dir and args.output_eval_json:
                root = frames.pages.agg(F.min("doc_id")).first()[0] or ""
                _save(args.output_eval_json, json.dumps(evaluation(got, args.golden_dir, os.path.abspath(args.input_path), root), ensure_ascii=False, indent=2))
            outputs = {"json": (args.output_json, got.json, "{}"), "md": (args.output_md, got.markdown, ""), "rag": (args.output_rag_json, lambda: chunk_json(got.chunks()), "[]"), "debug": (args.output_debug_json, got.debug, "{}")}
            for name, (path, make, empty) in outputs.items():
                if many:
                    if path:
                        make().write.mode("overwrite").json(path)
                        print(f"Saved: {path}")
                    continue
                if path:
                    text = _one(make(), empty)
                    _save(path, text if name == "md" else _pretty(text))
                elif name == "json":
                    print(_pretty(_one(make(), empty)))
                elif name == "md" and not args.output_json:
                    print("\n--- MARKDOWN ---\n")
                    print(_one(make(), empty))
    finally:
        scratch.remove()


def main() -> None:
    spark = SparkSession.builder.appName("leafstack").getOrCreate()
    try:
        run(spark)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
