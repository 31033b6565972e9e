"""Pages as a browser renders them, by an optional browser library; tests hand in their own opener.

A rendered page is HTML like any other: ``functions.html.parse_html`` gives its fields (alternative
texts are null where absent), ``operators.merge.overlay_pages`` lays them over the parsed ones.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import pandas as pd
from pyspark.sql import DataFrame

RENDERED = "url string, final_url string, status_code int, html string, dom_loaded_seconds double, fully_loaded_seconds double, error string"
DOM_SECONDS, IDLE_SECONDS = 60, 30

#: url -> (final URL, status, HTML, seconds to the loaded DOM, seconds to the idle network)
Renderer = Callable[[str], tuple[str, int, str, float, float]]


@contextmanager
def browser(user_agent: str = "sitelume/1.0") -> Iterator[Renderer]:
    """A headless browser for one task. Network that doesn't become idle in time is no failure."""
    try:
        from playwright.sync_api import Error, sync_playwright
    except ImportError as e:
        raise RuntimeError("rendering needs the playwright package and its browser on every executor") from e
    with sync_playwright() as p:
        instance = p.chromium.launch()
        try:
            context = instance.new_context(user_agent=user_agent)

            def render(url: str) -> tuple[str, int, str, float, float]:
                page, began = context.new_page(), time.monotonic()
                try:
                    response = page.goto(url, wait_until="domcontentloaded", timeout=DOM_SECONDS * 1000)
                    loaded = time.monotonic() - began
                    try:
                        page.wait_for_load_state("networkidle", timeout=IDLE_SECONDS * 1000)
                    except Error:
                        pass
                    return page.url, response.status if response else 0, page.content(), loaded, time.monotonic() - began
                finally:
                    page.close()

            yield render
        finally:
            instance.close()


def render(asked: DataFrame, opener: Callable[[], AbstractContextManager[Renderer]] = browser, partitions: int = 5) -> DataFrame:
    """The rendered form of each URL (url), one browser a partition; a page that fails has an error and no HTML."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opener() as page:
            for rows in batches:
                for url in rows["url"]:
                    try:
                        final, status, html, dom, full = page(url)
                        row = (url, final, status, html, round(dom, 3), round(full, 3), None)
                    except Exception as e:  # any failure of the browser is a result
                        row = (url, None, None, None, None, None, f"{type(e).__name__}: {e}")
                    yield pd.DataFrame([row], columns=[c.split(" ")[0] for c in RENDERED.split(", ")]).astype({"status_code": "Int64"})

    return asked.select("url").distinct().repartition(partitions, "url").mapInPandas(run, RENDERED)
