"""Descriptors to pooled image features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pixelseek.operators.descriptors import BETA, KNN, PYRAMID, learn_dictionary, llc_code, spm_pool


def llc_spm_features(
    descriptors: DataFrame,
    dictionary: DataFrame | None = None,
    method: str = "kmeans",
    size: int = 512,
    knn: int = KNN,
    beta: float = BETA,
    pyramid: tuple[int, ...] = PYRAMID,
    seed: int = 0,
) -> DataFrame:
    """(image_id, bin, word_id, v) with unit norm per image; learns a dictionary if none is given."""
    words = dictionary if dictionary is not None else learn_dictionary(descriptors, method, size, seed)
    return spm_pool(llc_code(descriptors, words, knn, beta), pyramid)
