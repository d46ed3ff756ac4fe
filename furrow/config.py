"""Parameter sets of the pipelines."""

from __future__ import annotations

from dataclasses import dataclass

# Scene search, band list, scene-classification codes that hide the ground.
MAX_SEARCH_CLOUD = 80.0
WINDOW_DAYS = 5
TOP_K_PER_WINDOW = 1
BANDS = ("B02", "B03", "B04", "B08", "B11", "SCL")
MASKED_SCL = (0, 1, 3, 8, 9, 10, 11)
SCENE_MIN_PX = 10
PAD = 0.0

# Index names in export order, and the two subsets the models read.
INDEX_NAMES = ("NDVI", "NDMI", "NDWI", "EVI", "GNDVI", "SAVI", "OSAVI", "MSAVI", "MNDWI", "ARVI", "BSI")
TABULAR_INDICES = ("NDVI", "EVI", "NDMI", "NDWI")
TENSOR_INDICES = ("NDVI", "NDMI", "NDWI", "GNDVI", "SAVI", "OSAVI", "MSAVI", "MNDWI", "ARVI", "BSI")

MISSING_GROUP = -100


@dataclass(frozen=True)
class TabularParams:
    """Filters of a long-table-to-classifier run."""

    indices: tuple[str, ...] = TABULAR_INDICES
    max_cloud: float = 40.0
    min_px: int = 10
    min_class_count: int = 50
    max_dates: int = 0
    phenology: bool = True
    fill: str = "per_index"
    fit_on: str = "train"
    test_size: float = 0.2
    seed: int = 42


# The filter settings of each published run.
FOREST = TabularParams()
SEQUENCE = TabularParams(min_class_count=200, max_dates=30, phenology=False, fill="interleaved")
BOOSTED = TabularParams(min_px=5, min_class_count=200)


@dataclass(frozen=True)
class TensorParams:
    """Settings of the regular time-grid path."""

    indices: tuple[str, ...] | None = TENSOR_INDICES
    max_cloud: float | None = None
    min_px: int = 0
    frequency: str | None = None
    min_obs: int = 4
    fill_value: float = 0.0
    split_method: str = "parcel"
    test_size: float = 0.2
    val_size: float = 0.1
    stratify: bool = True
    seed: int = 42
