"""Schemas of the files that are read and written."""

from __future__ import annotations

from pyspark.sql import types as T

SCORED_ROW = T.StructType(
    [
        T.StructField("pred", T.StringType()),
        T.StructField("gt", T.StringType()),
        T.StructField("cer", T.DoubleType()),
        T.StructField("wer", T.DoubleType()),
        T.StructField("der", T.DoubleType()),
    ]
)

_BY_COMPONENT = T.MapType(T.StringType(), T.LongType())

SIDECAR = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("phantom", T.StringType()),
        T.StructField(
            "metrics",
            T.StructType(
                [
                    T.StructField("n", T.LongType()),
                    T.StructField("cer", T.DoubleType()),
                    T.StructField("wer", T.DoubleType()),
                    T.StructField("der", T.DoubleType()),
                    T.StructField("der_n", T.LongType()),
                    T.StructField("der_insertion_rate", T.DoubleType()),
                ]
            ),
        ),
        T.StructField(
            "artifacts",
            T.StructType(
                [
                    T.StructField("jsonl", T.StringType()),
                    T.StructField("csv", T.StringType()),
                    T.StructField("checkpoint_pdparams", T.StringType()),
                    T.StructField("checkpoint_sha256", T.StringType()),
                    T.StructField("dict_path", T.StringType()),
                    T.StructField("dict_sha256", T.StringType()),
                    T.StructField("dict_size", T.LongType()),
                    T.StructField("rec_config", T.StringType()),
                    T.StructField("rec_config_sha256", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "provenance",
            T.StructType(
                [
                    T.StructField("model_kind", T.StringType()),
                    T.StructField("ckpt_prefix", T.StringType()),
                    T.StructField("dict_path", T.StringType()),
                    T.StructField("rec_config", T.StringType()),
                    T.StructField(
                        "checkpoint_integrity",
                        T.StructType(
                            [
                                T.StructField("ckpt_prefix", T.StringType()),
                                T.StructField("n_model_params", T.LongType()),
                                T.StructField("n_ckpt_params", T.LongType()),
                                T.StructField("n_restored", T.LongType()),
                                T.StructField("n_missing", T.LongType()),
                                T.StructField("n_shape_mismatch", T.LongType()),
                                T.StructField("n_extra_in_ckpt", T.LongType()),
                                T.StructField("missing_by_component", _BY_COMPONENT),
                                T.StructField("shape_mismatch_by_component", _BY_COMPONENT),
                                T.StructField("missing_sample", T.ArrayType(T.StringType())),
                                T.StructField(
                                    "shape_mismatch_sample",
                                    T.ArrayType(
                                        T.StructType(
                                            [
                                                T.StructField("key", T.StringType()),
                                                T.StructField("model_shape", T.ArrayType(T.LongType())),
                                                T.StructField("ckpt_shape", T.ArrayType(T.LongType())),
                                            ]
                                        )
                                    ),
                                ),
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)
