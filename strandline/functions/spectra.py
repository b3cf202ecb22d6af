"""Spectra as arrays of peaks (``mz``, ``intensity``, ``annotation``): matching, angle, ratings, and peptide notation.

A spectrum has some hundred peaks, so that matching stays inside its row: nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The reporter window, and the limits of ratings.
REPORTER_WINDOW = (125.5, 131.5)
ANGLE_LIMITS = ((20.0, "High"), (45.0, "Moderate"), (70.0, "Poor"))
COVERAGE_LIMITS = ((25.0, "Sparse"), (50.0, "Partial"))
LONGEST_PEPTIDE = 30
#: Peaks of predicted and observed spectra, about, that are matched at once (some 30 MB of working arrays).
MATCH_PEAKS = 100_000
ION = r"^([by])(\d+)\+(\d+)"


def ion(annotation: Column) -> Column:
    """``kind`` (b or y), ``ordinal`` and ``charge``; null for other annotations."""
    part = lambda i: F.regexp_extract(annotation, ION, i)
    return F.when(annotation.rlike(ION), F.struct(part(1).alias("kind"), part(2).cast("int").alias("ordinal"), part(3).cast("int").alias("charge")))


def without_reporters(peaks: Column, low: float = REPORTER_WINDOW[0], high: float = REPORTER_WINDOW[1]) -> Column:
    return F.filter(peaks, lambda p: ~p["mz"].between(low, high))


def possible_fragments(peaks: Column, charge: Column) -> Column:
    """Peaks whose ion has less charge than the precursor, or no known charge."""
    return F.filter(peaks, lambda p: F.coalesce(ion(p["annotation"])["charge"] < charge, F.lit(True)))


MATCH = "array<struct<i:int,j:int,off:double,mz:double,observed_mz:double,predicted:double,observed:double,annotation:string>>"


def _peaks(spectra: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, place in the spectrum, and the peaks themselves, of a batch of spectra."""
    count = spectra.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count), spectra.flatten()


def _figures(peaks: pa.Array, field: str) -> np.ndarray:
    return pc.struct_field(peaks, field).cast(pa.float64()).to_numpy(zero_copy_only=False)


def matched(predicted: Column, observed: Column, ppm: float) -> Column:
    """For each predicted peak its place ``i``, the place ``j`` of the nearest observed peak (the first of equals), and both peaks' figures, if within tolerance.

    Of matches to one observed peak only the first predicted one counts; the others have no second choice. Peaks without an m/z match nothing; the
    matches of a null spectrum are null. Some spectra of a batch at a time are sorted by spectrum and m/z, and each predicted peak looks at its two neighbours.
    """

    def some_matched(predicted: pa.Array, observed: pa.Array) -> pa.Array:
        (row, i, p), (o_row, j, o) = _peaks(predicted), _peaks(observed)
        mz, o_mz = _figures(p, "mz"), _figures(o, "mz")
        some = np.flatnonzero(~np.isnan(mz))
        at = np.flatnonzero(~np.isnan(o_mz))
        at = at[np.lexsort((j[at], o_mz[at], o_row[at]))]  # observed peaks in order
        ends = np.concatenate([o_row[at], row[some]]), np.concatenate([o_mz[at], mz[some]])
        order = np.lexsort((np.repeat([1, 0], [len(at), len(some)]), ends[1], ends[0]))
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(order < len(at))
        after = before[len(at) :]  # of each predicted peak: the first observed one that is not below it
        new = np.append(True, (np.diff(o_row[at]) != 0) | (np.diff(o_mz[at]) != 0))[: len(at)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))  # of equal peaks
        best, off = np.full(len(some), -1), np.full(len(some), np.inf)
        for near in (after - 1, after):
            inside = np.flatnonzero((near >= 0) & (near < len(at)))
            inside = inside[o_row[at[near[inside]]] == row[some[inside]]]
            peak = at[first[near[inside]]]
            apart = np.abs(o_mz[peak] - mz[some[inside]])
            closer = (apart < off[inside]) | ((apart == off[inside]) & (j[peak] < j[best[inside]]))
            best[inside[closer]], off[inside[closer]] = peak[closer], apart[closer]
        within = np.flatnonzero((best >= 0) & (off <= mz[some] * ppm / 1e6))
        within = within[np.sort(np.unique(best[within], return_index=True)[1])]
        hit, mine = best[within], some[within]
        columns = {
            "i": pa.array(i[mine], pa.int32()), "j": pa.array(j[hit], pa.int32()), "off": pa.array(off[within]), "mz": pa.array(mz[mine]), "observed_mz": pa.array(o_mz[hit]),
            "predicted": pc.struct_field(p, "intensity").cast(pa.float64()).take(pa.array(mine)), "observed": pc.struct_field(o, "intensity").cast(pa.float64()).take(pa.array(hit)),
            "annotation": pc.struct_field(p, "annotation").cast(pa.string()).take(pa.array(mine)),
        }
        offsets = np.append(0, np.cumsum(np.bincount(row[mine], minlength=len(predicted)))).astype(np.int32)
        unknown = pc.or_(predicted.is_null(), observed.is_null())
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), list(columns)), mask=unknown)

    def run(predicted: pa.Array, observed: pa.Array) -> pa.Array:
        count = sum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (predicted, observed))
        piece = np.cumsum(count) // MATCH_PEAKS if len(count) else np.zeros(0, np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(count)]
        return pa.concat_arrays([some_matched(predicted.slice(a, b - a), observed.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])

    return F.arrow_udf(run, MATCH)(predicted, observed)


def ppm_error(match: Column) -> Column:
    return (match["observed_mz"] - match["mz"]) / match["mz"] * 1e6


def _dot(matches: Column, a: str, b: str) -> Column:
    return F.aggregate(matches, F.lit(0.0), lambda s, m: s + m[a] * m[b])


def angle(matches: Column) -> Column:
    """Spectral angle of matched intensities in degrees; 90 without matches or with a zero norm."""
    norms = F.sqrt(_dot(matches, "predicted", "predicted")) * F.sqrt(_dot(matches, "observed", "observed"))
    cosine = F.greatest(F.least(_dot(matches, "predicted", "observed") / norms, F.lit(1.0)), F.lit(-1.0))
    return F.when(norms > 0, F.degrees(F.acos(cosine))).otherwise(90.0)


def normalised(degrees: Column) -> Column:
    return 1 - degrees / 90


def cleavages(matches: Column, length: Column) -> Column:
    """Number of different backbone sites that the matched ions show: b ions count from the front, y ions from the end."""
    sites = F.transform(matches, lambda m: F.when(ion(m["annotation"])["kind"] == "b", ion(m["annotation"])["ordinal"]).when(ion(m["annotation"])["kind"] == "y", length - ion(m["annotation"])["ordinal"]))
    return F.size(F.array_distinct(F.filter(sites, lambda s: s.isNotNull())))


def cleavage_sites(length: Column) -> Column:
    return F.greatest(length - 1, F.lit(1))


def _limits(value: Column, limits: tuple, last: str) -> Column:
    out = F.when(value <= limits[0][0], limits[0][1])
    for most, name in limits[1:]:
        out = out.when(value <= most, name)
    return out.otherwise(last)


def angle_rating(degrees: Column) -> Column:
    return _limits(degrees, ANGLE_LIMITS, "Terrible")


def coverage_percent(found: Column, sites: Column) -> Column:
    return F.when(sites > 0, 100.0 * found / sites).otherwise(0.0)


def coverage_rating(percent: Column) -> Column:
    return _limits(percent, COVERAGE_LIMITS, "Majority")


def tier(rating: Column, coverage: Column) -> Column:
    """Overall confidence from both ratings."""
    return (
        F.when(rating == "High", F.when(coverage == "Sparse", "Moderate").otherwise("Strong")).when(rating == "Moderate", F.when(coverage == "Sparse", "Weak").otherwise("Moderate"))
        .when(rating == "Poor", F.when(coverage == "Majority", "Weak").otherwise("Insufficient")).otherwise("Insufficient")
    )


# Residues that carry a modification in the library, and how it writes them; no name holds a later residue.
RESIDUE_NAMES = {"C": "C[UNIMOD:4]", "K": "K[UNIMOD:737]", "m": "M[UNIMOD:35]"}


def library_notation(modified: Column) -> Column:
    """The spectral library's notation of a modified peptide; null for an acetylated N-terminus."""
    bare = F.regexp_replace(F.trim(modified), r"^n\[\d+\]", "")
    out = F.regexp_replace(bare, r"M\[147(?:\.\d*)?\]", "m")  # a lower-case letter stands for the oxidised residue while other masses go
    out = F.regexp_replace(out, r"\[[^\]]*\]", "")
    for residue, name in RESIDUE_NAMES.items():
        out = F.regexp_replace(out, residue, F.lit(name))
    return F.when(~F.trim(modified).rlike(r"^n\[43\]."), F.concat(F.lit("[UNIMOD:737]-"), out))


def is_predictable(notation: Column, longest: int = LONGEST_PEPTIDE) -> Column:
    """Whether the library can predict a peptide: it has a notation and is not too long."""
    return F.coalesce(F.length(F.regexp_replace(notation, r"\[UNIMOD:\d+\]|-", "")) <= longest, F.lit(False))


def spectrum_id(text: Column) -> Column:
    """``file`` and ``scan`` of an id like ``run.59377.59377.3``; null with fewer than four parts."""
    parts = F.split(text, r"\.")
    return F.when(F.size(parts) >= 4, F.struct(parts[0].alias("file"), parts[1].cast("long").alias("scan")))
