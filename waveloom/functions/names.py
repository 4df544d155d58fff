"""Parsing and composing names of recordings, channels, features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order in which feature types stand.
TYPE_ORDER = ("H_act", "H_mob", "H_compl", "con", "rbcorr", "bpcorr")
# Named frequency bands, inclusive bounds in Hz.
BANDS = {"tremor": (3, 10), "low_beta": (11, 22), "high_beta": (22, 30), "low_gamma": (30, 60), "high_gamma": (60, 90), "HFO1": (91, 200), "HFO2": (200, 300), "HFO3": (300, 400), "beta": (11, 30), "gamma": (30, 90), "HFO": (91, 400)}


def _got(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def modality(ch: Column) -> Column:
    return F.when(ch.startswith("LFP"), "LFP").when(ch.startswith("msrc"), "msrc").when(ch.startswith("EMG"), "EMG")


def parsed(df: DataFrame, feat: str = "feat") -> DataFrame:
    """Add ftype, fb1, fb2, ch1, ch2, mod1, mod2 of each feature name (absent parts are null)."""
    c = F.col(feat)
    hjorth, pair = r"^(H_[a-z]{1,5})_(\w+)$", r"^(?:rbcorr|bpcorr)_([a-zA-Z0-9]+)_(.+),([a-zA-Z0-9]+)_(.+)$"
    con = r"^con_([a-zA-Z0-9]+)_(\w+),(\w+)$"
    ftype = F.coalesce(_got(c, hjorth, 1), _got(c, r"^([a-zA-Z0-9]+)_", 1))
    fb1 = F.coalesce(_got(c, pair, 1), _got(c, con, 1))
    fb2 = F.coalesce(_got(c, pair, 3), _got(c, con, 1))
    ch1 = F.coalesce(_got(c, hjorth, 2), _got(c, pair, 2), _got(c, con, 2))
    ch2 = F.coalesce(_got(c, pair, 4), _got(c, con, 3))
    parts = {"ftype": ftype, "fb1": fb1, "fb2": fb2, "ch1": ch1, "ch2": ch2, "mod1": modality(ch1), "mod2": modality(ch2)}
    # a generator keeps the patterns out of the predicates above: each is evaluated once for a name
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in parts.items()]))))


def source(ch: Column) -> Column:
    """Struct (side, grp, parcel, comp) of a source channel name; the group is -1 where the name has none."""
    long, short = r"src([RL])_([0-9]+)_([0-9]+)_c([0-9]+)$", r"src([RL])_([0-9]+)_c([0-9]+)$"
    number = lambda p, g: F.try_to_number(_got(ch, p, g), F.lit("999999")).cast("int")
    return F.struct(
        F.coalesce(_got(ch, long, 1), _got(ch, short, 1)).alias("side"),
        F.when(_got(ch, long, 1).isNotNull(), number(long, 2)).when(_got(ch, short, 1).isNotNull(), F.lit(-1)).alias("grp"),
        F.coalesce(number(long, 3), number(short, 2)).alias("parcel"),
        F.coalesce(number(long, 4), number(short, 3)).alias("comp"),
    )


def recording(name: Column) -> Column:
    """Struct (subject, medcond, task) of a recording's name."""
    p = r"^(S\d{2,3})_(.+)_(.+)$"
    return F.struct(*[_got(name, p, k + 1).alias(n) for k, n in enumerate(("subject", "medcond", "task"))])


def side(ch: Column) -> Column:
    return _got(ch, r"^(?:LFP|msrc|EMG)([LR])", 1)


def opposite(s: Column) -> Column:
    return F.translate(s, "LR", "RL")


def any_of(c: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches from the name's begin."""
    return c.rlike("^(?:" + "|".join(patterns) + ")")


def rank(ftype: Column, ch1: Column, ch2: Column) -> Column:
    """Canonical order: by type, couplings of a channel with itself first."""
    return F.array_position(F.array(*map(F.lit, TYPE_ORDER)), ftype) + F.when(ch2.isNull() | (ch1 == ch2), 0.0).otherwise(0.1)


def conjunction(rules: list[Column]) -> Column:
    """All rules; a rule that can't be decided counts as failed."""
    return reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(False)) for r in rules], F.lit(True))


def selected(
    features: DataFrame,
    *,
    need_lfp: bool = False,
    lfp_side: str | None = None,
    brain_side: str | None = None,
    bands: list[str] | None = None,
    types: list[str] | None = None,
    modalities: list[str] | None = None,
    drop_self: bool = False,
    drop_cross_lfp: bool = False,
    cross_only: bool = False,
    self_only: bool = False,
    parcels: list[int] | None = None,
    not_parcels: list[int] | None = None,
    lfp_channel: str | None = None,
    drop_hfo: bool = False,
    cerebellum: dict[str, int] | None = None,
    cerebellum_only: bool = False,
    bands_of: dict[str, list[str]] | None = None,
    components: list[int] | None = None,
) -> DataFrame:
    """Rows of a parsed feature dimension that pass every rule that is set.

    `cerebellum` gives its parcel on each side: with `brain_side` the side of the brain is that side without its own cerebellum
    but with the opposite one (which serves the same side of the body); with `cerebellum_only` only these two parcels
    are left.  `bands_of` lists the bands that a modality may have, `components` the components of sources.
    """
    chans = F.array_compact(F.array("ch1", "ch2"))
    both = F.col("ch2").isNotNull()
    is_lfp, is_src = (lambda x: x.startswith("LFP")), (lambda x: x.startswith("msrc"))
    parcel = lambda x: source(x)["parcel"]
    rules = []
    if need_lfp:
        rules.append(F.exists(chans, is_lfp))
    if lfp_side:
        rules.append(F.forall(chans, lambda x: ~is_lfp(x) | (side(x) == lfp_side)))
    if cerebellum is not None:
        of_side = lambda x: F.when(side(x) == "L", F.lit(cerebellum["L"])).otherwise(F.lit(cerebellum["R"]))
        if cerebellum_only:
            rules.append(F.forall(chans, lambda x: ~is_src(x) | (parcel(x) == of_side(x))))
        elif brain_side:
            rules.append(F.forall(chans, lambda x: ~is_src(x) | ((side(x) == brain_side) != (parcel(x) == of_side(x)))))
    elif brain_side:
        rules.append(F.forall(chans, lambda x: ~is_src(x) | (side(x) == brain_side)))
    if bands:
        rules.append(F.coalesce(F.col("fb1").isin(bands), F.lit(True)) & F.coalesce(F.col("fb2").isin(bands), F.lit(True)))
    if types:
        rules.append(F.col("ftype").isin(types))
    if modalities:
        rules.append(F.col("mod1").isin(modalities) & F.coalesce(F.col("mod2").isin(modalities), F.lit(True)))
    if drop_self:
        rules.append(~both | (F.col("ch1") != F.col("ch2")))
    if drop_cross_lfp:
        rules.append(~both | ~(is_lfp(F.col("ch1")) & is_lfp(F.col("ch2")) & (F.col("ch1") != F.col("ch2"))))
    if cross_only:
        rules.append(both & (F.col("ch1") != F.col("ch2")))
    if self_only:
        rules.append(~both | (F.col("ch1") == F.col("ch2")))
    if parcels is not None:
        rules.append(F.forall(chans, lambda x: ~is_src(x) | parcel(x).isin(parcels)))
    if not_parcels is not None:
        rules.append(F.forall(chans, lambda x: ~is_src(x) | ~parcel(x).isin(not_parcels)))
    if bands_of is not None:
        for n in (1, 2):
            known = reduce(lambda a, b: a | b, [(F.col(f"mod{n}") == m) & F.col(f"fb{n}").isin(some) for m, some in bands_of.items()])
            rules.append(F.col(f"fb{n}").isNull() | known)
    if components is not None:
        rules.append(F.forall(chans, lambda x: ~is_src(x) | source(x)["comp"].isin(components)))
    if lfp_channel:
        rules.append(F.forall(chans, lambda x: ~is_lfp(x) | (x == lfp_channel)))
    if drop_hfo:
        rules.append(~F.coalesce(F.col("fb1").startswith("HFO"), F.lit(False)) & ~F.coalesce(F.col("fb2").startswith("HFO"), F.lit(False)))
    return features.filter(conjunction(rules))


def artifact_labels(ch: Column) -> Column:
    """The artifact labels that apply to a channel: of its modality, of its side of it, of itself."""
    kind = F.when(ch.startswith("LFP"), "LFP").otherwise("MEG")
    return F.array(F.concat(F.lit("BAD_"), kind), F.concat(F.lit("BAD_"), kind, side(ch)), F.concat(F.lit("BAD_"), ch))


def mask_sets(features: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """feat, labels, and labels, rec, n_bins, bins: which of the labels that occur apply to a feature, and what each such set of labels masks.

    Features are masked alike if the same labels apply to them, so the bins [b0, b1) of a recording are united once for a set
    and not for each of its features.
    """
    from ..operators.intervals import union

    some = artifacts.filter("b1 > b0")
    chans = features.select("feat", F.explode(F.array_distinct(F.array_compact(F.array("ch1", "ch2")))).alias("ch"))
    wanted = chans.select("feat", F.explode(artifact_labels(F.col("ch"))).alias("label")).join(some.select("label").distinct(), "label", "left_semi")
    sets = wanted.groupBy("feat").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    hit = sets.select("labels").distinct().select("labels", F.explode("labels").alias("label")).hint("merge").join(some, "label").select("labels", "rec", F.col("b0").alias("s"), F.col("b1").alias("e"))
    bins = F.array_sort(F.collect_list(F.struct(F.col("s").alias("b0"), F.col("e").alias("b1"))))
    masks = union(hit, ["labels", "rec"]).groupBy("labels", "rec").agg(F.sum(F.col("e") - F.col("s")).alias("n_bins"), bins.alias("bins"))
    return sets, masks


def artifact_masks(features: DataFrame, artifacts: DataFrame) -> DataFrame:
    """feat, rec, n_bins, bins: the bins [b0, b1) of each recording that an artifact (rec, label, b0, b1) of one of a feature's
    channels masks, as disjoint intervals.

    Labels meet labels (an equi-join), and intervals are united before they are counted: no bin becomes a row.
    """
    sets, masks = mask_sets(features, artifacts)
    return sets.join(masks, "labels").select("feat", "rec", "n_bins", "bins")


def renamed(features: DataFrame, channel: str, name: str) -> DataFrame:
    """Names and channels with one channel (a main one, say) called by another name."""
    other = lambda c: F.when(F.col(c) == channel, F.lit(name)).otherwise(F.col(c))
    return features.withColumns({"feat": F.regexp_replace("feat", rf"(?<![A-Za-z0-9]){channel}(?![A-Za-z0-9])", name), "ch1": other("ch1"), "ch2": other("ch2")})


# Names of coarse groups of parcels, and the parcels called motor-related where no other list is given.
CEREBELLUM, UNLABELED = "Cerebellum", "unlabeled"
MOTOR_PARCELS = ("Precentral", "Postcentral", "Supp_Motor_Area", "Paracentral_Lobule", "Rolandic_Oper", "Cerebellum")
TEST_PARCELS = ("Supp_Motor_Area", "Precentral")


def parcel_groupings(label: Column, motor: tuple[str, ...] = MOTOR_PARCELS) -> dict[str, Column]:
    """The coarse group of a parcel (<name>_<L or R>, or 'unlabeled') under every grouping."""
    sided = lambda name: F.concat(F.lit(f"{name}_"), F.right(label, F.lit(1)))
    both = lambda name: F.lit(f"{name}_B")
    base = F.regexp_replace(label, "_[LR]$", "")
    cerebellum, known = label.startswith(CEREBELLUM), label != UNLABELED

    def cases(*rules: tuple[Column | None, Column]) -> Column:
        out = F.when(~known, F.lit(UNLABELED))
        for when, then in rules:
            out = out.otherwise(then) if when is None else out.when(when, then)
        return out

    motor_cerebellum, motor_rest = cerebellum & base.isin(*motor), ~cerebellum & base.isin(*motor)
    groups = {
        "all": label,
        "all_raw": label,
        "merged": cases((None, both("brain"))),
        "merged_by_side": cases((None, sided("hemisphere"))),
        "CB_vs_rest": cases((cerebellum, label), (None, sided("notCerebellum"))),
        "CBmerged_vs_rest": cases((cerebellum, both(CEREBELLUM)), (None, sided("notCerebellum"))),
        "motor-related_incCB_vs_rest": cases((base.isin(*motor), sided("motor-related_incCB")), (None, sided("rest"))),
        "motor-related_only": F.when(base.isin(*motor), label).otherwise(UNLABELED),
        "test": F.when(base.isin(*TEST_PARCELS), label).otherwise(UNLABELED),
    }
    for name, own, side in (
        ("motor-related_vs_CB_vs_rest", label, sided),
        ("motor-related_vs_CBmerged_vs_rest", both(CEREBELLUM), sided),
        ("motor-related_vs_CB_vs_rest_merge_across_sides", both(CEREBELLUM), both),
    ):
        groups[name] = cases((motor_cerebellum, own), (motor_rest, side("motor-related")), (None, side("rest")))
    return groups


def add_body_side(parcel: Column, body_side: Column) -> Column:
    """A parcel without a side gets that opposite to the side of the body; the cerebellum lies on the same side."""
    return F.concat(parcel, F.lit("_"), F.when(parcel == CEREBELLUM, body_side).otherwise(opposite(body_side)))
