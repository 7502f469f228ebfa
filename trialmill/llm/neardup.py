"""The pipeline's near-duplicate stage: SimHash's covering tables and bands of minima, then the exact similarity.

SimHash's covering tables find all pairs of fingerprints within `radius` bits.  At a similarity of 0.8, however,
64-bit fingerprints differ in about 10 bits, out of reach of any covering that has a practical number of
tables; HyperMinHash bands are added for those, which pass over a pair at 0.8 with a chance of 1.5 in 100,000.
Whichever key brings a pair together, its whole shingle sets are compared.

Defined cases: null, empty and wordless texts are one group; fewer words than a shingle are one shingle;
a table without near-duplicates keeps every row; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from trialmill.llm import hyperminhash
from trialmill.llm.common import cut_lineage
from trialmill.llm.pairs import TILE
from trialmill.llm.simhash import RADIUS, covering_masks, keep_rows, majority

SHINGLE = 5
LEAST = (80, 100)
BANDS, ROWS = 28, 5


def table_keys(hashes: np.ndarray, masks: list[int]) -> np.ndarray:
    """A key for each covering table, of its number and the bits it keeps of the set's fingerprint."""
    bits = majority(hashes)
    return np.array([xxhash.xxh64_intdigest((bits & m).to_bytes(8, "little"), 1000 + t) for t, m in enumerate(masks)], np.uint64).view(np.int64)


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, least: tuple[int, int] = LEAST, radius: int = RADIUS,
    bands: int = BANDS, rows: int = ROWS, tile: int = TILE,
) -> DataFrame:
    """(doc_id, th, root) of every row; rows with one root are connected by pairs of similarity `least` or more."""
    masks = covering_masks(radius)
    found = cut_lineage(hyperminhash.sketches(docs, width, bands, rows, lambda hashes: table_keys(hashes, masks)))
    roots = hyperminhash.point_classes(docs, found, width, least, bands * rows, tile)
    joined = found.select("doc_id", "th", "point").join(roots, F.col("point") == F.col("node"), "left")
    return joined.select("doc_id", "th", F.coalesce("root", "point").alias("root"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near-duplicates, chosen as in `simhash.keep_one`."""
    return keep_rows(docs, near_duplicates(docs, **options))
