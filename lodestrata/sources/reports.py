"""Reports and styles from small results (K5-K8)."""

from __future__ import annotations

import base64
import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ramp_stops(bounds: DataFrame, n: int = 10) -> DataFrame:
    """stop, value: n values from vmin to vmax in equal steps (K8)."""
    step = (F.col("vmax") - F.col("vmin")) / (n - 1)
    return bounds.withColumn("stop", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("value", F.col("vmin") + F.col("stop") * step)


def qgis_style(stops: list[tuple[float, str]], name: str, opacity: float = 1.0) -> str:
    """A style document of (value, colour as #rrggbb or #rgb) stops: the shader's items, and the same stops as a gradient `colorramp` (K8).

    The gradient has its two ends as colours and the stops between them by their share of the way.
    """
    low, high = stops[0][0], stops[-1][0]
    span = (high - low) or 1.0
    long = lambda c: c if len(c) == 7 else "#" + "".join(x * 2 for x in c[1:])  # noqa: E731  #rgb means #rrggbb
    rgba = lambda c: ",".join(str(int(long(c)[i : i + 2], 16)) for i in (1, 3, 5)) + ",255"
    items = "".join(f'<item value="{v:.6g}" label="{v:.4g}" color="{html.escape(c)}" alpha="255"/>' for v, c in stops)
    between = ":".join(f"{(v - low) / span:.6g};{rgba(c)}" for v, c in stops[1:-1])
    props = {"color1": rgba(stops[0][1]), "color2": rgba(stops[-1][1])} | ({"stops": between} if between else {})
    ramp = f'<colorramp name="[{html.escape(name)}]" type="gradient">' + "".join(f'<prop k="{k}" v="{v}"/>' for k, v in props.items()) + "</colorramp>"
    return (
        f'<!DOCTYPE qgis><qgis><pipe><rasterrenderer type="singlebandpseudocolor" band="1" opacity="{opacity:g}" alphaBand="-1" classificationMin="{low:g}" classificationMax="{high:g}">'
        f'<rastershader><colorrampshader colorRampType="INTERPOLATED" classificationMode="1" clip="0" minimumValue="{low:g}" maximumValue="{high:g}" label="{html.escape(name)}">{items}{ramp}</colorrampshader></rastershader></rasterrenderer></pipe></qgis>'
    )


def _cell(v) -> str:
    if v is None:
        return "-"
    if isinstance(v, float):
        return f"{v:.4f}"
    return f"{len(v)} values" if isinstance(v, (list, tuple, dict)) and len(v) > 8 else str(v)


def audit_markdown(row: dict, model: str = "model") -> str:
    """An audit row as Markdown; long lists are summed up (K6)."""
    lines = [f"# Audit of {model}", "", f"Grade **{row['grade']}**, {row['tests_passed']} of {len(row['tests'])} tests passed.", "", "| Test | Result | Score | Threshold |", "|---|---|---|---|"]
    lines += [f"| {t['name']} | {'pass' if t['passed'] else 'fail'} | {_cell(t['score'])} | {_cell(t['threshold'])} |" for t in row["tests"]]
    if row.get("certificate"):
        lines += ["", f"Certificate: `{row['certificate']}`"]
    return "\n".join(lines) + "\n"


def audit_json(row: dict) -> str:
    return json.dumps(row, indent=2, default=str, sort_keys=True)


def html_report(title: str, metrics: dict, features: DataFrame | None = None, targets: DataFrame | None = None, top: int = 15, images: dict[str, bytes] | None = None) -> str:
    """A page of metrics, the `top` features by importance, ranked zones and embedded PNG images by caption; all text is escaped (K5)."""
    e = lambda v: html.escape(_cell(v))
    parts = [f"<h1>{e(title)}</h1>", "<table>" + "".join(f"<tr><th>{e(k)}</th><td>{e(v)}</td></tr>" for k, v in metrics.items()) + "</table>"]
    if features is not None:
        rows = features.orderBy(F.desc("importance"), "name").limit(top).collect()
        parts.append("<h2>Features</h2><table>" + "".join(f"<tr><td>{e(r['name'])}</td><td>{e(r['importance'])}</td></tr>" for r in rows) + "</table>")
    if targets is not None:
        rows = targets.orderBy("zone_rank").limit(200).collect()
        head = "".join(f"<th>{e(c)}</th>" for c in targets.columns)
        parts.append(f"<h2>Targets</h2><table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>")
    for caption, png in (images or {}).items():
        parts.append(f'<figure><img alt="{e(caption)}" src="data:image/png;base64,{base64.b64encode(png).decode()}"><figcaption>{e(caption)}</figcaption></figure>')
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{e(title)}</title></head><body>{"".join(parts)}</body></html>'


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines, one object a row (K9)."""
    results.write.mode("overwrite").json(path)
