"""Scalar formulas and threshold ladders as column expressions (P1-P39).  Strict or inclusive as noted; NULL falls through.

Labels are compared by later steps, so they are kept to the letter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .primitives import clip, flag, unit


def ladder(*rungs: tuple[Column, object], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in rungs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def among(x: Column, *values: str) -> Column:
    return x.isin(*values)


# ---- regimes of price and flow ----
def price_regime(breadth: Column, dispersion: Column, stress: Column, vix_z: Column) -> Column:
    """P25, the regime."""
    return ladder(
        ((stress == 1) | (vix_z > 1.5), "RISK OFF (estres alto)"),
        ((breadth > 0.2) & (dispersion < 0.02), "TREND STRONG (seguir lider)"),
        ((breadth < -0.2) & (dispersion > 0.03), "ROTATION ACTIVE (cambio de lider)"),
        (breadth > 0, "EXPANSION (rotacion moderada)"),
        otherwise="NEUTRAL",
    )


def price_action(breadth: Column, dispersion: Column, stress: Column, vix_z: Column) -> Column:
    """P25, what to do."""
    return ladder(
        ((stress == 1) | (vix_z > 1.5), "Reducir exposicion a ciclicos, aumentar defensivos o efectivo."),
        ((breadth > 0.2) & (dispersion < 0.02), "Mantener exposicion en el sector lider."),
        ((breadth < -0.2) & (dispersion > 0.03), "Rotacion activa. Esperar nuevo lider."),
        (breadth > 0, "Entorno favorable para ciclicos. Seguir rotacion."),
        otherwise="Sin senal clara. Esperar.",
    )


def flow_regime(breadth: Column, dispersion: Column) -> Column:
    """P28."""
    return ladder((breadth > 0.6, "ENTRADA GENERALIZADA (riesgo-on)"), (dispersion > 0.5, "ROTACION FUERTE (flujos dispersos)"), otherwise="FLUJO SELECTIVO")


def flow_intensity(z: Column) -> Column:
    """P26."""
    return ladder((z > 2.0, "Fuerte entrada"), (z > 0.8, "Entrada moderada"), (z < -2.0, "Fuerte salida"), (z < -0.8, "Salida moderada"), otherwise="Neutral")


def dispersion_text(dispersion: Column) -> Column:
    """P27, first half."""
    return ladder((dispersion > 0.5, "Alta dispersion (rotacion)"), (dispersion > 0.2, "Dispersion moderada (transicion)"), otherwise="Baja dispersion (trend)")


def vix_text(vix_z: Column) -> Column:
    """P27, second half; NULL when calm."""
    return F.when(vix_z > 1.5, "ALTA VOLATILIDAD").when(vix_z > 1.0, "Volatilidad elevada")


def macro_label(score: Column) -> Column:
    """P24."""
    return ladder((score > 0.5, "RISK-ON"), (score < -0.5, "RISK-OFF"), otherwise="NEUTRAL")


# ---- causal chain ----
def adaptive_window(vix_z: Column) -> Column:
    """Whole rows, 30 to 90."""
    return clip(60 * (1 - 0.25 * clip(vix_z, -2, 2)), 30, 90).cast("int")


def edge(macro: Column, flow: Column, structure: Column) -> Column:
    """Weighted tanh signals x (1 - population std of the three)."""
    f, m, s = F.tanh(flow), F.tanh(macro), 2 * structure - 1
    mean = (f + m + s) / 3
    spread = F.sqrt(((f - mean) * (f - mean) + (m - mean) * (m - mean) + (s - mean) * (s - mean)) / 3)
    return clip((0.5 * f + 0.3 * m + 0.2 * s) * (1 - spread), -1, 1)


def truth(macro: Column, flow: Column, structure: Column) -> Column:
    """P5."""
    agreement = (F.tanh(macro) * F.tanh(flow) + 1) / 2
    return clip((0.5 * F.abs(macro) + 0.5 * F.abs(flow)) * agreement * F.when(structure == 0, 0.5).otherwise(1.0), 0, 1)


def alignment(macro: Column, flow: Column, structure: Column) -> Column:
    """Share of the three signs that equal macro's."""
    same = lambda x: flag(F.signum(x) == F.signum(macro))
    return (same(macro) + same(flow) + same(structure)) / 3.0


def tradeable(edge_: Column, truth_: Column, structure: Column) -> Column:
    """Edges and truths on the threshold pass."""
    return (structure != 0) & ~F.coalesce(truth_ < 0.5, F.lit(False)) & ~F.coalesce(F.abs(edge_) < 0.3, F.lit(False))


# ---- distribution of a sector ----
def distribution_score(pm: Column, fm: Column, fa: Column, vz: Column) -> Column:
    """P6."""
    p, f, a, v = F.tanh(pm), F.tanh(fm), F.tanh(fa), F.tanh(vz)
    raw = p * (-f)
    div = F.when(F.abs(raw) < 0.02, 0.0).otherwise(raw)
    resid = (-f - div) * F.when(F.abs(f) < 0.2, 0.5).otherwise(1.0)
    acc = F.when(a < 0, -a).otherwise(-1.5 * a)
    return 2 * div + 0.8 * resid + acc + F.when(fm < 0, 0.8 * v).otherwise(0.0)


def distribution_probability(score: Column, temperature: float = 1.5) -> Column:
    """P7."""
    return 1 / (1 + F.exp(-score / temperature))


def distribution_class(score: Column) -> Column:
    """P8."""
    return ladder((score > 1.2, "FUERTE"), (score > 0.6, "MODERADA"), (score > 0.3, "DEBIL"), otherwise="NINGUNA")


def confidence(div: Column, vz: Column, acc: Column, score: Column) -> Column:
    """P9."""
    raw = F.abs(div) * (0.5 * F.abs(vz) + 0.5 * F.abs(acc))
    return ladder((score > 1.2, "ALTA"), (raw > 0.6, "ALTA"), (raw > 0.3, "MEDIA"), otherwise="BAJA")


def calm(vix_z: Column) -> Column:
    """1 / (1 + max(0, vix_z - 0.5)); an unknown vix_z is calm, as max(0, nan) is 0."""
    return 1 / (1 + F.coalesce(F.greatest(vix_z - 0.5, F.lit(0.0)), F.lit(0.0)))


def unified_score(p_bin: Column, p_cont: Column, conviction: Column, vix_z: Column) -> Column:
    """P10."""
    return (0.4 * p_bin + 0.3 * p_cont + 0.3 * unit(conviction)) * calm(vix_z)


def opportunity(pm: Column, fm: Column, fa: Column, vz: Column, phase: Column) -> Column:
    """P11."""
    bonus = F.when(among(phase, "ACUMULACION", "ACUMULACION FUERTE"), 0.2).when(among(phase, "DISTRIBUCION CONFIRMADA", "DISTRIBUCION TEMPRANA"), -0.2).otherwise(0.0)
    return 0.4 * fm + 0.3 * pm + 0.2 * F.tanh(fa) + 0.1 * vz + bonus


def operability(score: Column) -> Column:
    """P12."""
    return ladder((score > 0.4, "OPORTUNIDAD CLARA"), (score > 0.2, "OPORTUNIDAD MODERADA"), (score > 0.05, "SEGUIR CON PRUDENCIA"), otherwise="NO OPERAR")


def phase(pz: Column, fz: Column, az: Column) -> Column:
    """P13."""
    return ladder(
        ((pz > 1.0) & (fz < -0.5), "DISTRIBUCION CONFIRMADA"),
        ((pz > 0.5) & (fz < 0), "DISTRIBUCION TEMPRANA"),
        ((pz < -0.5) & (fz > 0.5), "ACUMULACION FUERTE"),
        ((pz < 0) & (fz > 0), "ACUMULACION"),
        ((fz > 0) & (az > 0), "CONFIRMACION ALCISTA"),
        ((fz < 0) & (az < 0), "CONFIRMACION BAJISTA"),
        ((F.abs(pz) < 0.2) & (fz < -0.5), "AGOTAMIENTO"),
        otherwise="NEUTRAL",
    )


def direction(fz: Column) -> Column:
    """P14."""
    return ladder((fz > 0.2, "ALCISTA"), (fz < -0.2, "BAJISTA"), otherwise="TRANSICION")


def macro_adjusted(conviction: Column, cot_z: Column) -> Column:
    """P15; as it is without a positioning z."""
    return conviction * (1 + 0.3 * F.coalesce(cot_z, F.lit(0.0)))


def volatility_adjusted(conviction: Column, vix_z: Column) -> Column:
    """P16."""
    return conviction * calm(vix_z)


def divergence(pm: Column, fm: Column) -> Column:
    """P17."""
    return -F.tanh(pm) * F.tanh(fm)


def binary_score(pm: Column, fm: Column, fa: Column, vz: Column) -> Column:
    """P18."""
    return 0.4 * flag((pm > 0) & (fm < 0)) + 0.2 * flag(fm < -0.1) + 0.3 * flag(fa < 0) + 0.1 * flag(vz > 1)


def binary_probability(score: Column, k: float = 5.0) -> Column:
    """P19."""
    return 1 / (1 + F.exp(-k * (score - 0.5)))


def system_confidence(vix_z: Column, breadth: Column, dispersion: Column) -> Column:
    """P20."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * F.greatest(F.lit(0.0), breadth) + 0.3 * (1 - F.when(vix_z.isNotNull(), F.least(vix_z, F.lit(2.0))) / 2) + 0.3 * (1 - dispersion)))


def signal_quality(pm: Column, fm: Column, vz: Column) -> Column:
    """P21."""
    return F.greatest(F.lit(0.0), F.abs(pm) + F.abs(fm) - 0.1 * F.abs(vz))


def signal_state(persistence: Column, phase_: Column) -> Column:
    """P22.  The early label is matched with an underscore, which the phases never carry: only ACUMULACION fires it."""
    return ladder(
        ((persistence == "TRANSICION") & among(phase_, "ACUMULACION", "DISTRIBUCION_TEMPRANA"), "SEÑAL TEMPRANA"),
        (among(persistence, "PERSISTENCIA_ALCISTA", "PERSISTENCIA_BAJISTA"), "SEÑAL CONSOLIDADA"),
        otherwise="NEUTRAL",
    )


def alert_level(score: Column) -> Column:
    """P23 of the binary score, inclusive."""
    return ladder((score >= 0.7, "DISTRIBUCION FUERTE"), (score >= 0.4, "POSIBLE DISTRIBUCION"), otherwise="SIN SENAL")


# ---- options, positioning, global layer, validation ----
def oms_class(x: Column) -> Column:
    """P29."""
    return ladder((x > 0.5, "ESTABLE"), (x < -0.5, "FRÁGIL"), otherwise="NEUTRO")


def oms_risk_bias(x: Column) -> Column:
    return ladder((x > 0.5, 1.10), (x < -0.5, 0.85), otherwise=1.0)


def oms_confidence(x: Column) -> Column:
    return ladder((x > 0.5, 1.05), (x < -0.5, 0.90), otherwise=1.0)


def global_score(flows: list[Column], credit: Column) -> Column:
    """The first flow is the home market's."""
    geo = sum((unit(f) for f in flows[1:]), unit(flows[0])) / float(len(flows))
    share = sum((flag(f > 0) for f in flows[1:]), flag(flows[0] > 0)) / float(len(flows))
    return clip(0.5 * geo + 0.45 * share + 0.05 * (F.tanh(credit) * F.tanh(flows[0]) + 1) / 2, 0, 1)


def median_of(*xs: Column) -> Column:
    """Median of non-null columns."""
    a = F.array_sort(F.array(*xs))
    n = len(xs)
    return F.get(a, F.lit(n // 2)) if n % 2 else (F.get(a, F.lit(n // 2 - 1)) + F.get(a, F.lit(n // 2))) / 2


def global_score_v3(flows: list[Column], credit: Column) -> Column:
    """P31."""
    geo = sum((unit(f) for f in flows[1:]), unit(flows[0])) / float(len(flows))
    return clip(0.5 * geo + 0.45 * unit(median_of(*flows)) + 0.05 * flag(F.signum(credit) == F.signum(flows[0])), 0, 1)


def coherence_product(a: Column, b: Column) -> Column:
    """P32."""
    return F.tanh(a) * F.tanh(b)


def dominance(home: Column, others_median: Column, threshold: float = 2.0) -> Column:
    """The absolute value of the median."""
    return F.abs(home) > threshold * F.abs(others_median)


def usd_trend(now: Column, before: Column) -> Column:
    """The last close over the 10th from last."""
    t = now / F.nullif(before, F.lit(0.0)) - 1
    return ladder((t > 0.02, "STRONG"), (t < -0.02, "WEAK"), otherwise="NEUTRAL")


def risk_driver(home: Column, bonds: Column, goods: Column, credit: Column, gold: Column) -> Column:
    """P35, the pattern."""
    return ladder(((home > 0) & (bonds > 0), "LIQUIDITY"), ((goods > 0) & (credit > 0), "REFLATION"), ((gold > 0) & (bonds > 0), "DEFENSIVE"), otherwise="MIXED")


def driver_confidence(driver: Column, previous: Column) -> Column:
    """P35, the confidence: how many of the last four drivers agree; MEDIUM without history."""
    same = F.size(F.filter(F.slice(previous, F.greatest(F.size(previous) - 3, F.lit(1)), 4), lambda d: d == driver))
    return F.when(previous.isNull(), "MEDIUM").when(F.size(previous) == 0, "LOW").when(same >= 4, "HIGH").when(same >= 2, "MEDIUM").otherwise("LOW")


def regime_label(score: Column) -> Column:
    """P36."""
    return ladder((score > 0.6, "RISK-ON"), (score > 0.5, "WEAK RISK-ON"), (score > 0.4, "NEUTRAL"), (score > 0.3, "WEAK RISK-OFF"), otherwise="RISK-OFF")


def cap_class(cap_musd: Column) -> Column:
    """P37."""
    return F.when(cap_musd.isNull(), "Unknown").when(cap_musd > 50000, "Large").when(cap_musd > 10000, "Mid").otherwise("Small")


def positioning_label(z: Column) -> Column:
    """P38."""
    return ladder((z > 1.5, "FUERTEMENTE ALCISTA"), (z > 0.5, "ALCISTA"), (z < -1.5, "FUERTEMENTE BAJISTA"), (z < -0.5, "BAJISTA"), otherwise="NEUTRAL")


def stale(as_of: Column, latest: Column, days: int = 8) -> Column:
    """P39."""
    return F.datediff(as_of, latest) > days


def exposure_label(rotation: Column, home_z: Column) -> Column:
    """A8's inferred consumer label."""
    return ladder(((rotation > 0.2) & (home_z > 0), "ACUMULACION FUERTE"), (rotation > 0, "ACUMULACION DEBIL"), otherwise="NEUTRAL/DEBIL")
