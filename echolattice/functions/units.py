"""Pitch and time units, time formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hertz of absolute cent 0, and of MIDI key 69.
CENT_ZERO, A4 = 8.17579892, 440.0


def _log2(x: Column) -> Column:
    return F.log2(F.when(x > 0, x))


def hertz_to_absolute_cent(hz: Column) -> Column:
    """Null for hertz that aren't positive, as for all conversions from hertz."""
    return 1200 * _log2(hz / F.lit(CENT_ZERO))


def absolute_cent_to_hertz(cent: Column) -> Column:
    return F.lit(CENT_ZERO) * F.pow(F.lit(2.0), cent / 1200)


def hertz_to_relative_cent(hz: Column) -> Column:
    return F.pmod(hertz_to_absolute_cent(hz), F.lit(1200.0))


def relative_cent_to_hertz(cent: Column) -> Column:
    """In the octave that begins at absolute cent 6000."""
    return absolute_cent_to_hertz(cent + 6000)


def hertz_to_midi_cent(hz: Column) -> Column:
    return 12 * _log2(hz / F.lit(A4)) + 69


def midi_cent_to_hertz(midi: Column) -> Column:
    return F.lit(A4) * F.pow(F.lit(2.0), (midi - 69) / 12)


def hertz_to_midi_key(hz: Column) -> Column:
    return F.floor(hertz_to_midi_cent(hz) + 0.5).cast("int")


def midi_key_to_hertz(key: Column) -> Column:
    """Null outside 0 to 127."""
    return F.when(key.between(0, 127), midi_cent_to_hertz(key))


def ratio_to_cent(ratio: Column) -> Column:
    return 1200 * _log2(ratio)


def cent_to_ratio(cent: Column) -> Column:
    return F.pow(F.lit(2.0), cent / 1200)


_FROM_HERTZ = {"hertz": lambda x: x, "absolute_cent": hertz_to_absolute_cent, "relative_cent": hertz_to_relative_cent, "midi_cent": hertz_to_midi_cent, "midi_key": hertz_to_midi_key}
_TO_HERTZ = {"hertz": lambda x: x, "absolute_cent": absolute_cent_to_hertz, "relative_cent": relative_cent_to_hertz, "midi_cent": midi_cent_to_hertz, "midi_key": midi_key_to_hertz}


def convert_pitch(x: Column, source: str, target: str) -> Column:
    return _FROM_HERTZ[target](_TO_HERTZ[source](x))


#: Seconds in a unit.
TIME_UNITS = {"nanoseconds": 1e-9, "microseconds": 1e-6, "milliseconds": 1e-3, "seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0}


def convert_time(x: Column, source: str, target: str) -> Column:
    return x * F.lit(TIME_UNITS[source]) / F.lit(TIME_UNITS[target])


def clock_time(name: Column, seconds: Column) -> Column:
    """HH:MM:SS of ``seconds`` after the yyyymmdd-hhmmss in a name (0 without one), within a day."""
    at = r"^.*(\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})(\d{2}).*$"
    part = lambda i: F.coalesce(F.regexp_extract(name, at, i).try_cast("int"), F.lit(0))
    total = (part(4) * 3600 + part(5) * 60 + part(6) + seconds) % 86400
    return F.format_string("%02d:%02d:%02d", F.floor(total / 3600), F.floor(total / 60) % 60, total % 60)


def stopwatch_time(nanos: Column) -> Column:
    """A duration with two decimals in its fitting unit: s, ms, micros or ns."""
    ms = F.floor(nanos / 1_000_000)
    return F.when(ms >= 1000, F.format_string("%.2f s", ms / 1000.0)).when(ms >= 1, F.format_string("%.2f ms", ms.cast("double"))).when(nanos >= 1000, F.format_string("%.2f micros", nanos / 1000.0)).otherwise(F.format_string("%.2f ns", nanos.cast("double")))


def span_text(seconds: Column) -> Column:
    """61.5 as ``1m:1s:500ms``; leading units of 0 are left out."""
    whole = F.floor(seconds)
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    ms = F.floor((seconds - whole) * 1000)
    some = lambda x, unit, shown: F.when(shown, F.concat(x.cast("string"), F.lit(unit))).otherwise("")
    return F.concat(some(h, "h:", h > 0), some(m, "m:", (h > 0) | (m > 0)), some(s, "s", whole > 0), F.when(ms > 0, F.concat(F.lit(":"), ms.cast("string"), F.lit("ms"))).otherwise(""))
