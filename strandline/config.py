"""Settings of the operators, with the defaults of the trajectory pipeline."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, is_dataclass


# The names and default values of the settings below.


@dataclass(frozen=True)
class TrackerConfig:
    track_thresh: float = 0.6
    track_low_thresh: float = 0.3
    new_track_thresh: float = 0.4
    track_buffer: int = 60
    match_thresh: float = 0.8
    proximity_thresh: float = 0.5
    appearance_thresh: float = 0.2
    with_reid: bool = True
    frame_rate: int = 25
    rounds: int = 2
    first_expand: float = 0.7
    expand_step: float = 0.1
    low_expand: float = 0.5
    low_match_thresh: float = 0.5
    duplicate_distance: float = 0.15
    feature_momentum: float = 0.9

    @property
    def lost_frames(self) -> int:
        return int(self.frame_rate / 30 * self.track_buffer)


@dataclass(frozen=True)
class NumberConfig:
    legibility_threshold: float = 0.6
    outlier_std: float = 0.5
    outlier_min_samples: int = 3
    use_outlier_filter: bool = True
    use_legibility: bool = True
    pad_left: float = 5.0
    pad_right: float = 5.0
    pad_top: float = 5.0
    pad_bottom: float = 0.0
    min_keypoint_score: float = 0.3


@dataclass(frozen=True)
class SplitConfig:
    number_min_fragment: int = 20
    number_min_persistence: int = 5
    number_lookahead: int = 20
    lookback: int = 50
    min_pixel_jump: float = 10.0
    entropy_threshold: float = 0.2
    team_min_persistence: int = 5
    team_min_fragment: int = 10
    team_lookahead: int = 50
    #: 'next': the entropy of the following row gates the whole window; 'own': each row's entropy gates itself.
    entropy_mode: str = "next"
    #: Whether rows without a team count as one more category of a team window.
    null_is_category: bool = True
    #: Rows of a series that one task looks at together.
    block: int = 65536


def fingerprint(*configs) -> str:
    """A short hash of settings (or names of what else counts), for the paths of tables that depend on them."""
    return hashlib.sha256(json.dumps([asdict(c) if is_dataclass(c) else c for c in configs], sort_keys=True).encode()).hexdigest()[:12]
