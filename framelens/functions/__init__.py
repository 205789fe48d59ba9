"""Column functions. All of them are Catalyst expressions; none runs Python per row."""

from framelens.functions.boxes import (
    Box,
    affine_bbox,
    affine_points,
    association_score,
    bbox_area,
    bbox_diagonal,
    bbox_iou,
    bbox_visible,
    best_face_score,
    center_distance,
    continuity_score,
    ellipse_contains,
    pad_bbox,
    quality_rank,
    scale_instances,
    selection_score,
    valid_affine,
)
from framelens.functions.pose import (
    axis_confidence,
    euler_from_matrix,
    image_quality,
    landmark_confidence,
    landmark_error,
    pose_from_kps,
    pose_opacity,
    pose_weight,
    reference_weight,
    truly_conditioned,
)
from framelens.functions.text import (
    cache_key,
    manifest_path,
    normalize_tokens,
    output_name,
    parse_size,
    path_parts,
    path_stem,
)
from framelens.functions.timeline import crossfade_weight, detection_due, full_scan_due, window_seed
from framelens.functions.vectors import (
    as_doubles,
    bhattacharyya,
    cosine,
    dot,
    l2_norm,
    l2_normalize,
    masked_mae,
    mean_abs_difference,
)

__all__ = [name for name in dir() if not name.startswith("_")]
