"""Settings of the engine: two fingerprint algorithms and the pitch-class histogram."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class AlgorithmConfig:
    """Parameters of one fingerprint algorithm. ``kind`` is 'constant_q' (robust to pitch and tempo) or 'fft' (robust to noise)."""

    kind: str = "constant_q"
    sample_rate: int = 16_000
    block_size: int = 1_024
    block_step: int = 128
    latency_samples: int = 0
    min_frequency: float = 110.0
    max_frequency: float = 7_040.0
    reference_frequency: float = 440.0
    bands_per_octave: int = 85
    min_bin: int = 2
    freq_max_filter: int = 103
    time_max_filter: int = 25
    points_per_print: int = 3
    min_freq_distance: int = 1
    max_freq_distance: int = 128
    min_time_distance: int = 2
    max_time_distance: int = 33
    query_range: int = 2
    min_hits_unfiltered: int = 10
    min_hits_filtered: int = 5
    min_time_factor: float = 0.8
    max_time_factor: float = 1.2
    min_freq_factor: float = 0.8
    max_freq_factor: float = 1.2
    min_seconds_with_match: float = 0.2
    min_match_duration: float = 5.0
    part_max_size: int = 250
    part_divider: int = 5
    fallback_to_histogram: bool = False

    @property
    def seconds_per_block(self) -> float:
        return self.block_step / self.sample_rate

    @property
    def latency_seconds(self) -> float:
        return self.latency_samples / self.sample_rate

    def but(self, **changes: object) -> AlgorithmConfig:
        return replace(self, **changes)


CONSTANT_Q = AlgorithmConfig()
FFT = AlgorithmConfig(kind="fft", min_bin=9, freq_max_filter=20, min_time_factor=0.9, max_time_factor=1.1, min_freq_factor=0.0, max_freq_factor=float("inf"))


@dataclass(frozen=True)
class PitchConfig:
    sample_rate: int = 22_050
    block_size: int = 2_048
    block_overlap: int = 1_024
    bins: int = 1_200


@dataclass(frozen=True)
class EngineConfig:
    """All settings. Precedence: call > file > default (:meth:`load`)."""

    strategy: str = "fft"
    monitor_window: float = 25.0
    monitor_overlap: float = 5.0
    number_of_results: int = 1_000
    max_file_size_mb: int = 6_000
    check_duplicates: bool = True
    cache_folder: str = ""
    decoder: str = ""
    storage: str = "table"
    constant_q: AlgorithmConfig = field(default=CONSTANT_Q)
    fft: AlgorithmConfig = field(default=FFT)
    pitch: PitchConfig = field(default=PitchConfig())

    @property
    def algorithm(self) -> AlgorithmConfig:
        return self.constant_q if self.strategy == "constant_q" else self.fft

    @classmethod
    def load(cls, text: str = "", **overrides: str) -> EngineConfig:
        """From ``name = value`` lines (``#`` comments) and overrides; ``constant_q.`` and ``fft.`` prefix an algorithm's settings."""
        given: dict[str, str] = {}
        for line in text.splitlines():
            line = line.strip()
            if line and not line.startswith(("#", "!")) and "=" in line:
                k, _, v = line.partition("=")
                given[k.strip()] = v.strip()
        given |= {k.replace("__", "."): str(v) for k, v in overrides.items()}
        flat: dict[str, object] = {}
        nested: dict[str, dict[str, object]] = {"constant_q": {}, "fft": {}, "pitch": {}}
        base = cls()
        for k, v in given.items():
            head, _, tail = k.partition(".")
            if head in nested and tail:
                nested[head][tail] = _typed(getattr(getattr(base, head), tail), v)
            else:
                flat[k] = _typed(getattr(base, k), v)
        return replace(base, **flat, **{k: replace(getattr(base, k), **x) for k, x in nested.items() if x})

    def dump(self) -> list[tuple[str, str]]:
        """Name and value of every setting, sorted."""
        rows = []
        for f in fields(self):
            v = getattr(self, f.name)
            rows += [(f"{f.name}.{g.name}", str(getattr(v, g.name))) for g in fields(v)] if hasattr(v, "__dataclass_fields__") else [(f.name, str(v))]
        return sorted(rows)


def _typed(like: object, text: str) -> object:
    if isinstance(like, bool):
        return text.strip().lower() == "true"
    return type(like)(text)
