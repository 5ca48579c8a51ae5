"""Parameters of the analytics, as plain frozen records with the effective default values."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Pitch:
    length: float = 105.0
    width: float = 68.0
    box_depth: float = 16.5
    box_half_width: float = 20.16


@dataclass(frozen=True)
class Possession:
    radius_m: float = 2.0
    hysteresis_rows: int = 6


@dataclass(frozen=True)
class Events:
    carry_m: float = 5.0
    pass_m: float = 3.0
    gap_s: float = 4.0
    counter_window_s: float = 8.0
    counter_gain_m: float = 25.0
    counter_rows: int = 5


@dataclass(frozen=True)
class Kinematics:
    gap_frames: int = 3
    smooth_s: float = 0.5
    cap_mps: float = 11.0
    high_mps: float = 5.5
    sprint_mps: float = 7.0
    sprint_s: float = 0.7
    turn_mps: float = 1.5
    turn_deg: float = 60.0

    def window(self, fps: float) -> int:
        """Rows of the smoothing window: odd, five at least."""
        return max(5, round(self.smooth_s * fps) | 1)


@dataclass(frozen=True)
class Pressing:
    radius_m: float = 4.0
    near_m: float = 2.5
    closing_mps: float = 0.5
    gap_s: float = 0.6
    ppda_share: float = 0.6
    win_s: float = 3.0


@dataclass(frozen=True)
class Phases:
    dead_mps: float = 0.3
    dead_s: float = 1.5
    transition_s: float = 5.0
    transition_gain_m: float = 8.0
    high_press_m: float = 44.2
    low_block_m: float = 34.0


@dataclass(frozen=True)
class Control:
    nx: int = 52
    ny: int = 34
    reaction_s: float = 0.7
    speed_mps: float = 7.8
    sigma_s: float = 0.45


@dataclass(frozen=True)
class Threat:
    """The grid, and the priors of moves, shots, goals and completion."""

    nx: int = 16
    ny: int = 12
    reach_m: float = 18.0
    forward_m: float = 45.0
    forward_cut_m: float = 30.0
    move_weight: float = 2.0
    shot_share: float = 0.15
    shot_near: float = 0.9
    shot_m: float = 40.0
    shot_range: tuple[float, float] = (0.01, 0.85)
    shot_weight: float = 8.0
    goal_near: float = 0.55
    goal_m: float = 45.0
    goal_range: tuple[float, float] = (0.02, 0.5)
    goal_weight: float = 3.0
    complete: float = 0.78
    complete_range: tuple[float, float] = (0.5, 0.95)


@dataclass(frozen=True)
class Tracking:
    sure: float = 0.5
    unsure: float = 0.1
    birth: float = 0.6
    limit: float = 0.8
    second_limit: float = 0.5
    once_limit: float = 0.7
    lost_frames: int = 30
    looks_weight: float = 0.3
    speed_mps: float = 12.5
    aside_s: float = 8.0
    aside_looks: float = 0.25
    aside_m: float = 8.0
    ball_jump_px: float = 120.0
    ball_misses: int = 25
    camera_share: float = 0.5
    camera_jump: float = 0.6


@dataclass(frozen=True)
class Config:
    pitch: Pitch = field(default_factory=Pitch)
    possession: Possession = field(default_factory=Possession)
    events: Events = field(default_factory=Events)
    kinematics: Kinematics = field(default_factory=Kinematics)
    pressing: Pressing = field(default_factory=Pressing)
    phases: Phases = field(default_factory=Phases)
    control: Control = field(default_factory=Control)
    threat: Threat = field(default_factory=Threat)
    tracking: Tracking = field(default_factory=Tracking)
    fps: float = 25.0

    def with_overrides(self, overrides: dict) -> "Config":
        """The config with the given sections' values replaced, for example {"possession": {"radius_m": 3.0}}."""
        changed = {}
        for name, value in overrides.items():
            current = getattr(self, name)
            changed[name] = replace(current, **value) if isinstance(value, dict) else value
        return replace(self, **changed)

    def fingerprint(self) -> str:
        """First 16 hexadecimal digits of the SHA-256 of all values, sorted by name."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def of_match(meta: dict, base: Config | None = None) -> Config:
    """The config of a match, with frame rate and pitch from its row of metadata where they are known."""
    known = {k: float(meta[k]) for k in ("fps", "pitch_length", "pitch_width") if meta.get(k)}
    pitch = {k.removeprefix("pitch_"): v for k, v in known.items() if k != "fps"}
    return (base or Config()).with_overrides(({"pitch": pitch} if pitch else {}) | ({"fps": known["fps"]} if "fps" in known else {}))


DEFAULT = Config()
