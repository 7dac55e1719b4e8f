"""Fixed values and the decision parameters shared by every stage."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

# They must agree with the published results.
FOREIGN = 107
SEED = 20260918
VAL_FRACTION = 0.15
TEST_FRACTION = 0.15
HELD_OUT_CLASSES = 12
PHOTO_MAX_SIDE = 1280
ALLOWLIST_MAX_SIDE = 1600
MIN_BOX_SIDE = 2
DETECTOR_INPUT = 640
PAD_VALUE = 114
DETECTOR_CONF = 0.25
DETECTOR_IOU = 0.6
DETECTOR_MAX = 100
MATCH_IOU = 0.5
CROP_SIZE = 128
CROP_CONTEXT = 0.12
TRAIN_CROP_SIZE = 160
TRAIN_CROP_CONTEXT = 0.30
EMBEDDING_DIM = 128
PIXEL_MEAN = (0.485, 0.456, 0.406)
PIXEL_STD = (0.229, 0.224, 0.225)
PROTOTYPES_PER_CLASS = 3
MIN_PER_CENTRE = 8
THRESHOLD_GRID = 41
CALIBRATION_BINS = 15
MAX_FALSE_ALARM = 0.10
MAX_ABSTAIN = 0.20
MIN_OUT_RECALL = 0.95
TRAINING_SCALE = 30.0
BOX_RATIO_RANGE = (0.80, 1.25)
MIN_BOX_IOU = 0.75
MIN_COSINE = 0.95
MAX_ACCURACY_DROP = 0.05
HEADLINE_REASONS = ("listed", "removed", "foreign", "unseen")


@dataclass(frozen=True)
class Params:
    """Decision parameters; the defaults are the unfitted ones."""

    temperature: float = 0.05
    unknown_bias: float | None = 0.55
    theta_in: float = 0.80
    theta_out: float = 0.30
    margin: float = 0.0
    platt_a: float = 1.0
    platt_b: float = 0.0

    def with_(self, **changes) -> Params:
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> Params:
        """Unknown keys are dropped, missing or null ones take the default."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: float(v) for k, v in values.items() if k in known and v is not None})
