"""The registered queries of the training-data operators, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracle


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_docs(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination, report

    return report(contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).drop("items", "starts", "ends")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages

    return languages(_docs(spark, sf_dir))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_docs(spark, sf_dir))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find, report

    return report(find(_docs(spark, sf_dir)))


def op8_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .blockdedup import repeats

    return repeats(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import repeats

    return repeats(_docs(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_docs(spark, sf_dir)).drop("blocks")


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiff import digest, encode

    return digest(encode(_docs(spark, sf_dir)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op1_packing": op1_packing, "op2_simhash": op2_simhash, "op3_decontamination": op3_decontamination, "op4_tiff": op4_tiff, "op5_licenses": op5_licenses, "op6_language": op6_language, "op7_quality": op7_quality, "op8_blocks": op8_blocks, "op9_pii": op9_pii, "op10_suffix": op10_suffix}
ORACLE_SQL = {"op3_decontamination": oracle.DECONTAMINATION, "op5_licenses": oracle.LICENSES, "op8_blocks": oracle.BLOCKS, "op10_suffix": oracle.SUFFIX}
