"""Text and HTML from small, collected results."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, Row


def _pct(x: float | None) -> str:
    return "n/a" if x is None else f"{x:+.1%}"


def _num(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.2f}"


def facts(phases: DataFrame, stats: DataFrame, overfit: DataFrame | None = None) -> dict:
    """What a brief says: the latest phase, the first strategy's measures, the overfitting estimate."""
    last: Row | None = phases.orderBy("date", ascending=False).limit(1).first()
    perf: Row | None = stats.limit(1).first()
    odds: Row | None = overfit.limit(1).first() if overfit is not None else None
    out = {"date": last["date"] if last else None, "phase": last["phase"] if last else None, "factor": last["value"] if last else None}
    out |= {k: perf[k] if perf else None for k in ("months", "ann_return", "ann_vol", "sharpe", "max_drawdown")}
    return out | {"pbo": odds["pbo"] if odds else None, "configs": odds["n_configs"] if odds else None}


def brief(f: dict) -> str:
    """A few sentences from the facts; what is not known is said to be so."""
    text = [f"As of {f['date'] or 'no date'} the cycle is in: {f['phase'] or 'unknown'} (factor {_num(f['factor'])})."]
    text.append(f"Over {f['months'] or 0} months the timing strategy returned {_pct(f['ann_return'])} a year at a volatility of {_pct(f['ann_vol'])}: Sharpe ratio {_num(f['sharpe'])}, largest drawdown {_pct(f['max_drawdown'])}.")
    if f["pbo"] is not None:
        text.append(f"Of {f['configs']} configurations the probability of backtest overfitting is {f['pbo']:.0%}.")
    return "\n".join(text)


def table(df: DataFrame, most: int = 200) -> str:
    """An HTML table of a small result."""
    rows = df.limit(most).collect()
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(show(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def line_chart(values: list[float | None], width: int = 720, height: int = 160) -> str:
    """An inline SVG line; gaps where values are missing."""
    known = [v for v in values if v is not None]
    if not known:
        return "<p>no data</p>"
    low, high = min(known), max(known)
    step, scale = width / max(1, len(values) - 1), (height - 10) / ((high - low) or 1)
    parts: list[list[str]] = [[]]
    for i, v in enumerate(values):
        if v is None:
            parts.append([])
        else:
            parts[-1].append(f"{i * step:.1f},{height - 5 - (v - low) * scale:.1f}")
    lines = "".join(f'<polyline fill="none" stroke="currentColor" points="{" ".join(p)}"/>' for p in parts if p)
    return f'<svg viewBox="0 0 {width} {height}" role="img">{lines}</svg>'


def drawdown_chart(growth: list[float]) -> str:
    """A curve of growth and, below it, how far it stands under its highest point so far."""
    falls, top = [], 0.0
    for v in growth:
        top = max(top, v)
        falls.append(v / top - 1 if top else None)
    return line_chart(growth) + line_chart(falls, height=80)


def stat_card(row: Row | None) -> str:
    """The main measures of one run as a list."""
    names = {"ann_return": "Return a year", "ann_vol": "Volatility", "max_drawdown": "Largest drawdown", "hit_rate": "Months won"}
    if row is None:
        return ""
    items = [(label, _pct(row[k])) for k, label in names.items()] + [("Sharpe", _num(row["sharpe"])), ("Calmar", _num(row["calmar"])), ("Months", str(row["months"]))]
    return "<dl>" + "".join(f"<dt>{escape(k)}</dt><dd>{escape(v)}</dd>" for k, v in items) + "</dl>"


def prediction_charts(oos: DataFrame) -> str:
    """Outcome and each model's predictions, one line below the other."""
    rows = oos.orderBy("date").collect()  # one row a month
    charts = [("outcome", [r["y_true"] for r in rows])] + [(c.removeprefix("pred_"), [r[c] for r in rows]) for c in oos.columns if c.startswith("pred_")]
    return "".join(f"<h3>{escape(name)}</h3>{line_chart(values)}" for name, values in charts)


def dashboard(title: str, sections: dict[str, str]) -> str:
    """A page that needs nothing from elsewhere; an empty section says so."""
    style = "body{font:15px sans-serif;max-width:60em;margin:2em auto}table{border-collapse:collapse}td,th{padding:.2em .6em;border-bottom:1px solid #ccc;text-align:right}"
    body = "".join(f"<section><h2>{escape(k)}</h2>{v or '<p>not available</p>'}</section>" for k, v in sections.items())
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{style}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>'
