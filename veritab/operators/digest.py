"""A run's report as HTML within a budget of bytes, and as an e-mail."""

from __future__ import annotations

from email.message import EmailMessage
from html import escape

from pyspark.sql import DataFrame

from .ranking import MOST_ROWS

#: The most bytes of a report; mail readers cut longer ones.
MOST_BYTES = 90_000
_STYLE = "body{font:16px/1.5 sans-serif;max-width:44em;margin:1em auto}h2{border-bottom:1px solid #ccc}.c{margin:0 0 1em}.m{color:#555}"


def href(url: str | None) -> str:
    """A link's target: http addresses only, escaped; "" for others."""
    url = (url or "").strip()
    return escape(url, quote=True) if url.lower().startswith(("http://", "https://")) else ""


def _link(title: str | None, url: str | None) -> str:
    return f'<a href="{href(url)}">{escape(title or "")}</a>' if href(url) else escape(title or "")


def card(row) -> str:
    """One posting in full."""
    why = f"<br>{escape(row['reason'])}" if row.asDict().get("reason") else ""
    return f'<div class="c"><b>{row["place"]}. {_link(row["title"], row["url"])}</b><br>{escape(row["company"] or "")} <span class="m">{row["score"]}, {escape(row["verdict"] or "")}</span>{why}</div>'


def line(row) -> str:
    return f"<li>{_link(row['title'], row['url'])}, {escape(row['company'] or '')} ({row['score']})</li>"


def html(name: str, shown_rows: DataFrame, hidden: DataFrame, alarms: list[str] = (), shortlist: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> str:
    """The report: alarms, cards of what is shown (lines from the first that doesn't fit), what is hidden by group, the shortlist. Never longer than most_bytes; what is left out is counted.

    Each table is bounded by its own cap, and by MOST_ROWS.
    """
    rows = shown_rows.filter("place is not null").orderBy("place").limit(MOST_ROWS).collect()
    hid = hidden.limit(MOST_ROWS).collect()
    saved = shortlist.limit(MOST_ROWS).collect() if shortlist is not None else []
    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(name)}</title><style>{_STYLE}</style></head><body><h1>{escape(name)}</h1>'
    end = "</body></html>"
    # Room for the closing lines that say what was left out.
    left = most_bytes - len((head + end).encode()) - 400
    out: list[str] = []

    def put(piece: str) -> bool:
        nonlocal left
        size = len(piece.encode())
        if size > left:
            return False
        out.append(piece)
        left -= size
        return True

    for a in alarms:
        put(f"<p><b>{escape(a)}</b></p>")
    put(f"<h2>{len(rows)} to read</h2>")
    short = len(rows)
    for i, row in enumerate(rows):
        if not put(card(row)):
            short = i
            break
    cut = sum(not put(line(r)) for r in rows[short:])
    if hid:
        put("<h2>Hidden by your rules</h2>")
    for group in dict.fromkeys(r["group"] for r in hid):
        of = [r for r in hid if r["group"] == group]
        put(f"<h3>{escape(group)} ({of[0]['in_group']})</h3>")
        cut += sum(not put(f"<li>{_link(r['title'], r['url'])}, {escape(r['company'] or '')}: {escape(r['reason'] or '')}</li>") for r in of)
    if saved:
        put("<h2>Shortlist</h2>")
        cut += sum(not put(f"<li>{_link(r['title'], r['url'])}, {escape(r['company'] or '')}: {escape(r['state'])}</li>") for r in saved)
    more = f"<p>{cut} more are left out for want of room.</p>" if cut else ""
    return head + "".join(out) + more + end


def message(subject: str, sender: str, to: str, page: str, plain: str) -> EmailMessage:
    """The report as a mail: plain text, and HTML beside it. A header holds no line break."""
    mail = EmailMessage()
    mail["Subject"], mail["From"], mail["To"] = (" ".join(x.split()) for x in (subject, sender, to))
    mail.set_content(plain)
    mail.add_alternative(page, subtype="html")
    return mail


def send(mail: EmailMessage, host: str, port: int = 587, user: str = "", password: str = "", connect=None) -> str:
    """Delivers a mail over SMTP with TLS; "" or why it failed. A report that can't be mailed is still written, so this never raises."""
    import smtplib

    try:
        with (connect or smtplib.SMTP)(host, port, timeout=30) as server:
            server.starttls()
            if user:
                server.login(user, password)
            server.send_message(mail)
    except (OSError, smtplib.SMTPException) as e:
        return f"{type(e).__name__}: {e}"
    return ""
