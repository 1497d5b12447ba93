"""Settings: defaults under the user's file, checked, with memory shared out."""

from __future__ import annotations

import copy
from typing import Any

import yaml

#: Defaults of what the engine reads. Sections for devices aren't in them, as nothing here plays or records.
DEFAULTS: dict[str, Any] = {
    "max_memory_mb": 1024.0,
    "recorder": {"audio": {"sample_rate": 44100, "bit_depth": 16, "chunk_size": 512, "channels": None, "input": None, "audio_format": "wav", "ambisonic_format": None}, "buffer": {"max_seconds": 60}},
    "player": {"max_polyphony": 8, "limiter_threshold_db": -1.5, "limiter_ceiling_db": -0.1, "midi_map": None, "strict_midi_map": True},
    "detection": {"snr_threshold_db": 12.0, "hold_time": 0.5, "warmup_seconds": 1.0, "ema_alpha": 0.1, "trim_pre_samples": 10, "trim_post_samples": 90},
    "analysis": {"start_bpm": 120.0, "tempo_min": 30.0, "tempo_max": 300.0},
    "instrument": {"max_memory_mb": None, "directory": "samples/captures"},
    "similarity": {"weight_spectral": 1.0, "weight_timbre": 1.0, "weight_timbre_delta": 0.5, "weight_timbre_onset": 1.0, "weight_band_energy": 1.0},
    "transform": {"max_memory_mb": None, "carrier_memory_mb": None, "max_disk_mb": None, "target_bpm": 0.0, "quantize_resolution": 16},
}
#: Allowed choices, and least and greatest numbers.
CHOICES = {("recorder", "audio", "bit_depth"): {16, 24, 32}, ("recorder", "audio", "audio_format"): {"wav", "flac"}, ("transform", "quantize_resolution"): {1, 2, 4, 8, 16}}
BOUNDS = {
    ("player", "max_polyphony"): (1, 64), ("player", "limiter_threshold_db"): (-12.0, 0.0), ("player", "limiter_ceiling_db"): (None, 0.0),
    ("similarity", "weight_spectral"): (0.0, 2.0), ("similarity", "weight_timbre"): (0.0, 2.0), ("similarity", "weight_timbre_delta"): (0.0, 2.0),
    ("similarity", "weight_timbre_onset"): (0.0, 2.0), ("similarity", "weight_band_energy"): (0.0, 2.0), ("detection", "ema_alpha"): (None, 1.0),
}
POSITIVE = [("recorder", "audio", "sample_rate"), ("recorder", "audio", "chunk_size"), ("recorder", "buffer", "max_seconds"), ("detection", "ema_alpha"), ("detection", "hold_time"), ("analysis", "tempo_min"), ("analysis", "tempo_max")]
#: Shares of the memory for sounds, variants and carriers; disk as a multiple of the variants' share.
SHARES, DISK = {"instrument": 0.60, "transform": 0.35, "carrier": 0.05}, 3


def merged(base: dict, over: dict) -> dict:
    """over on base, section by section; a section that over leaves empty keeps base's."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        if isinstance(out.get(key), dict):
            if isinstance(value, dict):
                out[key] = merged(out[key], value)
            elif value is not None:
                out[key] = value
        else:
            out[key] = copy.deepcopy(value)
    return out


def at(config: dict, path: tuple[str, ...]) -> Any:
    for key in path:
        config = config[key]
    return config


def load(text: str = "") -> dict:
    """Checked settings from YAML. Memory limits not given are shares of max_memory_mb."""
    config = merged(DEFAULTS, yaml.safe_load(text) or {})
    for path, allowed in CHOICES.items():
        if at(config, path) not in allowed:
            raise ValueError(f"{'.'.join(path)} must be one of {sorted(allowed)}")
    for path, (low, high) in BOUNDS.items():
        value = float(at(config, path))
        if (low is not None and value < low) or (high is not None and value > high):
            raise ValueError(f"{'.'.join(path)} must be from {low} to {high}")
    for path in POSITIVE:
        if float(at(config, path)) <= 0:
            raise ValueError(f"{'.'.join(path)} must be over 0")
    audio, player, a = config["recorder"]["audio"], config["player"], config["analysis"]
    if audio["audio_format"] == "flac" and audio["bit_depth"] == 32:
        raise ValueError("flac has no 32 bits")
    chosen = audio["input"]
    if chosen is not None:
        if not chosen or any(not isinstance(c, int) or c < 1 for c in chosen) or len(set(chosen)) != len(chosen):
            raise ValueError("recorder.audio.input has channels from 1, each once")
        if audio["channels"] not in (None, len(chosen)):
            raise ValueError("recorder.audio.channels is not the number of inputs")
        audio["channels"] = len(chosen)
    if audio["ambisonic_format"] and audio["channels"] != 4:
        raise ValueError("an ambisonic recording has 4 channels")
    if player["limiter_ceiling_db"] <= player["limiter_threshold_db"]:
        raise ValueError("the limiter's ceiling must be over its threshold")
    if a["tempo_min"] >= a["tempo_max"]:
        raise ValueError("analysis.tempo_min must be under tempo_max")
    whole, t = float(config["max_memory_mb"]), config["transform"]
    given = lambda value, share: float(share if value is None else value)
    config["instrument"]["max_memory_mb"] = given(config["instrument"]["max_memory_mb"], whole * SHARES["instrument"])
    t["max_memory_mb"] = given(t["max_memory_mb"], whole * SHARES["transform"])
    t["max_disk_mb"] = given(t["max_disk_mb"], DISK * t["max_memory_mb"])
    t["carrier_memory_mb"] = given(t["carrier_memory_mb"], whole * SHARES["carrier"])
    return config
