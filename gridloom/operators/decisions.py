"""Decision lists. A list that assigns in order and lets later lines overwrite earlier ones is one CASE read from its end."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.operators.indices import BSI_BARE, NDMI_WET, NDVI_SPARSE, NDVI_VEG
from gridloom.schema import SURFACE, fails_if_null


def last_wins(lines: Iterable[tuple[Column, object]], default=None) -> Column:
    """Value of the last line whose condition is true; a NULL condition is not true."""
    out = None
    for condition, value in reversed(list(lines)):
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def first_wins(lines: Iterable[tuple[Column, object]], default=None) -> Column:
    return last_wins(list(lines)[::-1], default)


def true(condition: Column) -> Column:
    """The condition with NULL as false, so that its negation is true where it is unknown."""
    return F.coalesce(condition, F.lit(False))


def surface_class(ndvi: Column, ndmi: Column, bsi: Column, scl: Column, water: Column, edge: Column, valid: Column) -> Column:
    """Ten surface classes. edge: within one cell of the water's boundary, on either side."""
    v, m, b = (fails_if_null(x, -9.0) for x in (ndvi, ndmi, bsi))
    dry = true(valid) & ~true(water)
    is_ = SURFACE.__getitem__
    return last_wins(
        [
            (true(valid), is_("AMBIGUOUS")),
            (true(valid) & true(water), is_("OPEN_WATER")),
            (true(valid) & true(edge), is_("SHALLOW_OR_MIXED_WATER")),
            (dry & true(scl == 5) & (v < NDVI_SPARSE) & (m < NDMI_WET), is_("DRY_BARE_SEDIMENT")),
            (dry & (b >= BSI_BARE) & (v < NDVI_SPARSE) & (m < NDMI_WET), is_("DRY_BARE_SEDIMENT")),
            (dry & (m >= NDMI_WET) & (v < NDVI_VEG) & (b < BSI_BARE), is_("WET_SEDIMENT")),
            (dry & (v >= NDVI_SPARSE) & (v < NDVI_VEG) & (m < NDMI_WET), is_("SPARSE_HERBACEOUS")),
            (dry & (v >= NDVI_VEG) & (m < NDMI_WET), is_("DENSE_HERBACEOUS")),
            (dry & (v >= NDVI_VEG) & (m >= NDMI_WET), is_("REED_OR_FLOODED_VEGETATION")),
        ],
        is_("INVALID"),
    )


def base_class(ndvi: Column, ndwi: Column, mndwi: Column, ndmi: Column, bsi: Column, n_obs: Column, water_share: Column, cover: Column, least_obs: int = 3, wet_share: float = 20.0) -> Column:
    """Surface before an event: 0 water, 1 vegetation, 2 bare, 3 built, 4 wetland, 5 other dry, 6 uncertain, NULL not observed."""
    valid = ndvi.isNotNull() & ndwi.isNotNull() & mndwi.isNotNull() & (n_obs > 0)
    enough = valid & (n_obs >= least_obs)
    water = enough & ((fails_if_null(water_share, -1.0) >= wet_share) | ((ndwi > 0) & (mndwi > 0)))
    bare = true(cover == 60) | true((bsi >= BSI_BARE) & (ndvi < NDVI_SPARSE) & (ndmi < NDMI_WET))
    green = true(ndvi >= NDVI_SPARSE) | true(cover.isin(10, 20, 30, 40, 95, 100))
    return first_wins([(water, 0), (enough & bare, 2), (enough & true(cover == 90), 4), (enough & true(cover == 50), 3), (enough & green, 1), (enough, 5), (valid, 6)])


def decision_stability(core: Column, central: Column, possible: Column, valid: Column) -> Column:
    """1 core, 2 central only, 3 possible only, 4 never, NULL not valid."""
    return first_wins([(~true(valid), F.lit(None).cast("int")), (true(core), 1), (true(central), 2), (true(possible), 3)], 4)


def semantic_state(base: Column, central: Column, valid: Column) -> Column:
    """0 was water, 1-5 flooded over vegetation, wetland, built, bare, other, 6 not flooded, 7 base unknown, NULL not valid."""
    flooded = F.element_at(F.create_map(*(F.lit(x) for x in (1, 1, 4, 2, 3, 3, 2, 4, 5, 5))), base)
    return first_wins([(~true(valid) | base.isNull(), F.lit(None).cast("int")), (base == 0, 0), (base == 6, 7), (true(central), flooded)], 6)


def threshold_class(score: Column, low: float, mid: float, high: float) -> Column:
    """core / central / possible / none by three thresholds, each inclusive."""
    return F.when(score >= high, "core").when(score >= mid, "central").when(score >= low, "possible").when(score.isNotNull(), "none")


def weak_label(n_pre_obs: Column, n_pre_wet: Column, water_share: Column, n_peak_wet: Column, n_post_wet: Column, n_post_obs: Column, need_peak: int = 2, need_post: int = 2, most_share: float = 20.0) -> Column:
    """1 positive, 0 negative, 2 unlabelled, NULL never observed. A missing water share must not pass the land test."""
    land = (n_pre_obs >= 1) & (n_pre_wet == 0) & (fails_if_null(water_share, 100.0) < most_share)
    return last_wins([(land & (n_post_wet == 0) & (n_post_obs >= need_post), 0), (land & (n_peak_wet >= need_peak), 1), (n_pre_obs + n_post_obs == 0, F.lit(None).cast("int"))], 2)


def combined_label(label: Column, radar_wet: Column, model: Column) -> Column:
    """1 flood where label, radar and model agree; 0 where the label is dry and the model does not object; NULL disputed or unknown.
    model: 0 no, 1 possible, 2 central, NULL no data."""
    flood = true(label == 1) & true(radar_wet) & true(model == 2)
    dry = true(label == 0) & ~true(model == 1) & ~true(model == 2)
    disputed = true(radar_wet) & true(model.isNotNull() & (model != 2))
    return last_wins([(dry, 0), (flood, 1), (disputed, F.lit(None).cast("int"))], F.lit(None).cast("int"))


def reference_reason(domain: Column, n_valid: Column, n_wet: Column) -> Column:
    """1 water, 2 land, 3 too few, 4 outside the domain, 5 none, 6 mixed. domain: 0 none, 1 inside, 2 extended."""
    share = n_wet / F.greatest(n_valid, F.lit(1))
    inside = domain == 1
    return first_wins([(domain == 2, 4), (inside & (n_valid < 3), 3), (inside & (n_wet <= 1), 2), (inside & (share >= 0.5), 1), (inside, 6)], 5)


def support_distance_class(km: Column) -> Column:
    return F.when(km <= 3, "near").when(km <= 10, "middle").when(km.isNotNull(), "far")


def radar_flag(lag: Column, valid_share: Column, dark_share: Column, open_share: Column, open_obs: Column, open_dark: Column, least_valid: float = 0.3, dark_high: float = 0.5, dark_low: float = 0.1, least_open: float = 0.2, least_open_obs: float = 0.5) -> Column:
    """Evidence of one radar scene for a component; LATER_ in front where the scene is of a later day."""
    none = lag.isNull() | valid_share.isNull() | (valid_share < least_valid)
    opened = (open_share >= least_open) & (open_obs >= least_open_obs) & (open_dark <= dark_low)
    kind = first_wins([(dark_share >= dark_high, "S1_WATER"), (opened, "S1_OPEN_SURFACE_NO_WATER"), ((valid_share >= 0.5) & (dark_share <= dark_low), "S1_NO_WATER_SIGNAL_VEGETATED")], "S1_INCONCLUSIVE")
    return F.when(none, "S1_UNOBSERVED").otherwise(F.concat(F.when(lag == 0, "").otherwise("LATER_"), kind))


def retained_verdict(kind: Column, flag: Column) -> Column:
    return F.when(F.coalesce(kind, F.lit("")) != "TRAPPED", "").when(flag == "S1_WATER", "RETAINED_PLAUSIBLE").when(flag == "S1_OPEN_SURFACE_NO_WATER", "LIKELY_DRAINED").otherwise("RETAINED_UNCERTAIN")


def _decided(evidence: Column) -> Column:
    return evidence.isin("S1_WATER", "S1_DRY", "S2_WATER", "S2_DRY")


def day_evidence(optical: Column, optical_wet: Column, blind: Column, radar: Column, radar_wet: Column, plausible: Column, open_ground: Column) -> Column:
    """What a day's images say of a cell. Optical images decide first. Where none was had, or it is blind to water under plants, radar may:
    for water where water is plausible, for dry on open ground. BLIND: seen and undecided, NONE: not seen."""
    optical_says = first_wins([(~true(optical), "NONE"), (optical_wet, "S2_WATER"), (~blind, "S2_DRY")], "BLIND")
    radar_says = first_wins([(radar_wet & plausible, "S1_WATER"), (~radar_wet & open_ground, "S1_DRY")], "BLIND")
    return F.when(true(radar) & ~_decided(optical_says), radar_says).otherwise(optical_says)


def day_state(evidence: Column, probability: Column, reference_water: Column, receding: Column, weak: Column, wet: float = 0.8, dry: float = 0.05) -> Column:
    """(state, source) of a cell-day: decided evidence, then permanent reference water, then the model where it is sure; a receding cell
    without evidence is not called dry by the model alone."""
    seen = _decided(evidence)
    sure = (probability >= wet) | ((probability <= dry) & ~(true(receding) & ~reference_water))
    state = first_wins([(seen, F.substring_index(evidence, "_", -1)), (reference_water | (probability >= wet), "WATER"), (sure, "DRY")], "UNKNOWN")
    source = first_wins([(seen, F.concat(F.lit("EO_"), F.substring(evidence, 1, 2))), (reference_water, "REFERENCE"), (sure & weak, "MODEL_WEAK"), (sure, "MODEL_STRONG")], "NONE")
    return F.struct(state.alias("state"), source.alias("source"))


def digitize(x: Column, edges: Iterable[float]) -> Column:
    """Number of edges at or below x: bins closed on the left."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(x >= e, 1).otherwise(0)
    return F.when(x.isNotNull(), out)


def cut(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Bins closed on the right; NULL outside."""
    return first_wins([((x > a) & (x <= b), name) for a, b, name in zip(edges, edges[1:], labels, strict=False)])


def flags(bits: dict[int, Column]) -> Column:
    """OR of the bits whose condition is true."""
    out = F.lit(0)
    for bit, condition in bits.items():
        out = out.bitwiseOR(F.when(condition, F.lit(bit)).otherwise(F.lit(0)))
    return out


def flag_names(value: Column, names: dict[int, str]) -> Column:
    """The names of all set bits."""
    return F.filter(F.array(*(F.when(value.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for b, n in names.items())), lambda x: x.isNotNull())
