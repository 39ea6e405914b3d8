"""Fetching filings one by one, politely; ``get`` is any function of a URL that gives (status, text).

The requests share one rate limit, so they run on the driver; everything after them is tables.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

from siltstone.sources.filings import COMPANIES, FORM, MIN_DOCUMENT_CHARS

Get = Callable[[str], tuple[int, str]]

#: Servers of submissions and documents (fixed values).
SUBMISSIONS = "https://data.sec.gov/submissions/CIK{cik}.json"
ARCHIVE = "https://www.sec.gov"


def http_get(agent: str, timeout: float = 30) -> Get:
    """A plain client that names its user."""

    def get(url: str) -> tuple[int, str]:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace")

    return get


def _ask(get: Get, url: str) -> tuple[int, str]:
    """An answer, or status 0 for any error."""
    try:
        return get(url)
    except Exception:  # noqa: BLE001  the caller goes on with the next address
        return 0, ""


def latest(get: Get, company: str, cik: str, form: str = FORM) -> dict | None:
    """Metadata of a company's newest filing of a form."""
    padded = cik.zfill(10)
    status, text = _ask(get, SUBMISSIONS.format(cik=padded))
    if status != 200:
        return None
    recent = json.loads(text).get("filings", {}).get("recent", {})
    rows = zip(*(recent.get(k, []) for k in ("form", "accessionNumber", "filingDate", "primaryDocument")))
    for kind, number, date, name in rows:
        if kind == form:
            return {"company": company, "cik": cik, "accession_number": number, "accession_flat": number.replace("-", ""), "filing_date": date, "primary_doc": name}
    return None


def _addresses(get: Get, folder: str, name: str) -> Iterator[str]:
    """The primary document, then what the folder's index lists."""
    yield f"{folder}/{name}"
    _, index = _ask(get, f"{folder}/")
    links = re.findall(r'href="([^"]+\.html?)"', index, re.IGNORECASE) or re.findall(r'href="([^"]+\.txt)"', index, re.IGNORECASE)
    for link in links:
        yield link if link.startswith("http") else ARCHIVE + link


def document(get: Get, filing: dict) -> str | None:
    """The first address whose text is longer than a stub."""
    folder = f"{ARCHIVE}/Archives/edgar/data/{filing['cik'].zfill(10)}/{filing['accession_flat']}"
    for address in _addresses(get, folder, filing["primary_doc"]):
        status, text = _ask(get, address)
        if status == 200 and len(text) > MIN_DOCUMENT_CHARS:
            return text
    return None


def fetch_companies(get: Get, folder: str, companies: dict[str, str] = COMPANIES, pause: float = 0.5) -> list[dict]:
    """Save each company's document under ``folder/raw`` and list them in ``folder/manifest.json``."""
    raw, manifest = Path(folder) / "raw", []
    raw.mkdir(parents=True, exist_ok=True)
    for company, cik in companies.items():
        found = latest(get, company, cik)
        time.sleep(pause)
        text = found and document(get, found)
        time.sleep(pause)
        if text:
            slug = company.lower().translate(str.maketrans({" ": "_", "(": None, ")": None}))
            path = raw / f"{slug}_{found['filing_date']}.html"
            path.write_text(text, encoding="utf-8")
            manifest.append(found | {"local_file": str(path), "size_bytes": len(text)})
    (Path(folder) / "manifest.json").write_text(json.dumps(manifest, indent=1))
    return manifest
