"""Deletion risk: a 0 to 10 score from word lists, the source and the age of a post."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions import fixed
from vigil.functions.text import bound, matches
from vigil.functions.urls import source_risk

#: each word of the lists has such a letter, so one look spares a text without any of them the lists
LETTER = "[가-힣㈜]"


def _joined(title: Column, body: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))


def predict(title: Column, body: Column, url: Column, category: Column, age_hours: Column) -> Column:
    """struct(score, hard, source_risk, signals, components)."""
    text = _joined(title, body)
    w, label = fixed.RISK_WEIGHTS, fixed.RISK_SIGNALS
    lists = {"acc": fixed.ACCUSATION, "ent": fixed.ENTITY, "whi": fixed.WHISTLEBLOWER, "pre": fixed.PRESSURE, "leg": fixed.LEGAL, "dur": fixed.DURABLE}
    found = bound(F.struct(text.alias("text"), matches(text, LETTER).alias("any")), lambda t: F.struct(*[(t["any"] & matches(t["text"], p)).alias(k) for k, p in lists.items()]))
    known = F.struct(found.alias("in"), source_risk(url).alias("src"), F.coalesce(category == "kindness", F.lit(False)).alias("kind"), age_hours.alias("age"))

    def of(f: Column) -> Column:
        acc, ent, whi, pre, leg, dur = (f["in"][k] for k in lists)
        both = ent & acc
        axis = [("entity_accusation", both), ("accusation", acc & ~ent), ("entity", ent & ~acc)]
        halved = lambda n: F.when(f["kind"], n // 2).otherwise(n)
        parts = [(k, on, halved(w[k])) for k, on in axis]
        parts += [("whistleblower", whi, F.lit(w["whistleblower"])), ("pressure", pre, F.lit(w["pressure"])), ("legal", leg, F.lit(w["legal"]))]
        source = F.when(f["src"] == "high", w["source_high"]).when(f["src"] == "medium", w["source_medium"]).otherwise(w["source_unknown"])
        parts.append(("source", f["src"] != "low", source))
        fresh = F.when(f["age"] <= 24, w["fresh_24h"]).otherwise(w["fresh_72h"])
        parts.append(("fresh", F.coalesce(f["age"] <= 72, F.lit(False)), fresh))
        parts.append(("kindness_penalty", f["kind"] & ~pre, F.lit(-w["kindness_penalty"])))
        parts.append(("durable", dur & ~(pre | both), F.lit(-1)))
        entries = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(k).alias("key"), n.cast("int").alias("value"))) for k, on, n in parts]))
        total = sum((F.when(on, n).otherwise(0) for _, on, n in parts), F.lit(0))
        shown = {"source": f["src"] == "high", "fresh": F.coalesce(f["age"] <= 24, F.lit(False))}
        signals = F.array_compact(F.array(*[F.when(shown.get(k, on), label[k]) for k, on, _ in parts if k in label]))
        return F.struct(
            F.greatest(F.lit(0), F.least(F.lit(10), total)).cast("int").alias("score"),
            (both | pre | leg).alias("hard"),
            f["src"].alias("source_risk"),
            signals.alias("signals"),
            F.map_from_entries(entries).alias("components"),
        )

    return bound(known, of)


def classify(title: Column, body: Column) -> Column:
    """critique if the text accuses, else kindness."""
    text = _joined(title, body)
    return F.when(matches(text, LETTER) & matches(text, fixed.ACCUSATION), "critique").otherwise("kindness")
