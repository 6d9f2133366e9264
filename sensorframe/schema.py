"""Names, schemas, widths and settings shared by every module."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import types as T

# The names and orders below are part of the data format.
MODALITIES = ("Depth_Color", "IR", "Thermal", "IMU", "Radar", "Skeleton")
REQUIRED_MODALITIES = ("Depth_Color", "IR", "IMU", "Skeleton")
PLAYER_MODALITIES = ("Depth_Color", "IR", "Thermal", "Skeleton")
IMU_DEVICES = ("WTLA", "WTRA", "WTC", "WTLL", "WTRL")
IMU_PAIRS = (
    ("WTLA", "WTRA"),
    ("WTLL", "WTRL"),
    ("WTLA", "WTC"),
    ("WTRA", "WTC"),
    ("WTLL", "WTC"),
    ("WTRL", "WTC"),
)
IMU_CHANNELS = (
    "acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "acc_norm", "gyro_norm",
    "angle_x", "angle_y", "angle_z", "mag_x", "mag_y", "mag_z", "q0", "q1", "q2", "q3",
)
BASE_CHANNELS = IMU_CHANNELS[:8]
ANGLE_CHANNELS = IMU_CHANNELS[8:11]
QUATERNION_CHANNELS = IMU_CHANNELS[14:18]
BLOCKS = (
    "depth", "ir", "imu", "skeleton",
    "depth_engineered", "ir_engineered", "imu_engineered", "skeleton_engineered",
)
PCA_COMPONENTS = {"depth": 64, "ir": 64, "imu": 128, "skeleton": 128}

# Human3.6M joint order.
JOINTS = (
    "pelvis", "r_hip", "r_knee", "r_ankle", "l_hip", "l_knee", "l_ankle", "spine", "thorax",
    "neck", "head", "l_shoulder", "l_elbow", "l_wrist", "r_shoulder", "r_elbow", "r_wrist",
)
JOINT = {name: index for index, name in enumerate(JOINTS)}
# Skeleton edges, parent before child.
EDGES = (
    (0, 1), (1, 2), (2, 3), (0, 4), (4, 5), (5, 6), (0, 7), (7, 8),
    (8, 9), (9, 10), (8, 11), (11, 12), (12, 13), (8, 14), (14, 15), (15, 16),
)
# Joints at both ends and the vertex of each measured angle.
ANGLES = (
    ("l_shoulder", "l_elbow", "l_wrist"),
    ("r_shoulder", "r_elbow", "r_wrist"),
    ("l_elbow", "l_shoulder", "l_hip"),
    ("r_elbow", "r_shoulder", "r_hip"),
    ("l_shoulder", "l_hip", "l_knee"),
    ("r_shoulder", "r_hip", "r_knee"),
    ("l_hip", "l_knee", "l_ankle"),
    ("r_hip", "r_knee", "r_ankle"),
)
DISTANCES = (
    ("l_wrist", "head"),
    ("r_wrist", "head"),
    ("l_wrist", "r_wrist"),
    ("l_ankle", "r_ankle"),
    ("l_wrist", "l_hip"),
    ("r_wrist", "r_hip"),
    ("l_shoulder", "r_shoulder"),
)

# Modality weights of each late-fusion profile.
FUSION_WEIGHTS = {
    "equal": {"depth": 1.0, "ir": 1.0, "imu": 1.0, "skeleton": 1.0},
    "motion": {"depth": 0.75, "ir": 0.5, "imu": 1.25, "skeleton": 1.25},
    "wearables": {"depth": 0.75, "ir": 0.5, "imu": 1.75, "skeleton": 1.0},
    "stacked": {"combined": 1.25, "depth": 0.75, "ir": 0.5, "imu": 1.25, "skeleton": 1.25},
}

COMPARISON_FIELDS = (
    "label", "algorithm", "artifact_name", "parameters", "accuracy", "macro_f1",
    "balanced_accuracy", "training_clips", "report",
)
METRICS = ("accuracy", "macro_f1", "balanced_accuracy")


@dataclass(frozen=True)
class FeatureConfig:
    """Settings of one feature table; stored beside it and compared on reload."""

    image_width: int = 64
    image_height: int = 48
    max_image_frames: int = 64
    image_grid_rows: int = 4
    image_grid_columns: int = 4
    coarse_rows: int = 12
    coarse_columns: int = 16
    include_legacy_ir: bool = False
    skeleton_frames: int = 32
    temporal_bins: int = 4
    spectral_samples: int = 64
    hog_orientations: int = 9
    hog_cell: int = 8
    hog_block: int = 2
    skeleton_layout: str = "h36m"

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @property
    def signal_size(self) -> int:
        return 10 + 2 * self.temporal_bins

    @property
    def circular_size(self) -> int:
        return 5 + 2 * self.temporal_bins

    def hog_size(self) -> int:
        rows = self.image_height // self.hog_cell - self.hog_block + 1
        columns = self.image_width // self.hog_cell - self.hog_block + 1
        return rows * columns * self.hog_block**2 * self.hog_orientations

    def width(self, block: str) -> int:
        grid = self.image_grid_rows * self.image_grid_columns
        gray = self.temporal_bins * (3 * grid + 9)
        devices = len(IMU_DEVICES)
        joints = len(JOINTS)
        return {
            "depth": 5 * (self.hog_size() + self.coarse_rows * self.coarse_columns + 5),
            "ir": 5 * (self.hog_size() + self.coarse_rows * self.coarse_columns + 5),
            "depth_engineered": gray + self.temporal_bins * 3 * grid + 3 * 12,
            "ir_engineered": gray,
            "imu": devices * 8 * self.signal_size,
            "imu_engineered": devices
            * (8 * 9 + 3 * self.circular_size + 5 * self.signal_size + 3 + 12)
            + len(IMU_PAIRS) * 8 * 3,
            "skeleton": self.skeleton_frames * (joints * 3 * 2 + joints),
            "skeleton_engineered": 24 * self.signal_size + joints * 4 + 5 * 4 + 22 + 7 * 9,
        }[block]


PEOPLE = T.ArrayType(
    T.StructType(
        [
            T.StructField("keypoints", T.ArrayType(T.ArrayType(T.DoubleType()))),
            T.StructField("keypoint_scores", T.ArrayType(T.DoubleType())),
        ]
    )
)
