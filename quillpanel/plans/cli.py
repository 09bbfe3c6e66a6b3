"""python -m quillpanel.plans.cli STAGE --store DIR ...: one pipeline stage, or all of them in order."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillpanel.config import SETTINGS
from quillpanel.operators import models as M
from quillpanel.plans import figures, pipeline, service
from quillpanel.runtime import prepare
from quillpanel.sources import readers
from quillpanel.sources.writers import Store

STAGES = ("initdb", "ingest", "score", "features", "analyse", "train", "xs", "monitor", "plots", "experiment", "all", "serve")
#: The order that ``all`` runs in; prices come before headlines.
ORDER = ("ingest", "score", "features", "analyse", "train", "xs", "monitor", "plots")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillpanel", description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--store", required=True)
    p.add_argument("--drop", action="store_true")
    p.add_argument("--prices", help="Parquet of prices")
    p.add_argument("--corpus", nargs="*", default=[], help="Parquet shards of raw headlines")
    p.add_argument("--extra-lag", type=int, default=SETTINGS.extra_lag_sessions)
    p.add_argument("--limit", type=int)
    p.add_argument("--batch-size", type=int, default=64, help="texts scored at a time")
    p.add_argument("--figures", default="reports", help="folder of drawn figures to serve")
    p.add_argument("--reload", action="store_true", help="load the served model again at every request")
    p.add_argument("--test-start", default=SETTINGS.test_start)
    p.add_argument("--model")
    p.add_argument("--ticker")
    p.add_argument("--rounds", type=int, default=200)
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    return p


def run(stage: str, store: Store, a: argparse.Namespace) -> None:
    settings = dataclasses.replace(SETTINGS, extra_lag_sessions=a.extra_lag, test_start=a.test_start)
    spark = store.spark
    if stage == "initdb":
        pipeline.init(store, a.drop)
    elif stage == "ingest":
        pipeline.init(store)
        if a.prices:
            pipeline.ingest_prices(store, readers.scan(spark, a.prices))
        if a.corpus:
            raw = readers.load_raw(spark, a.corpus)
            tickers = [r[0] for r in store.read("prices").select("ticker").distinct().orderBy("ticker").collect()]  # the universe
            pipeline.ingest_headlines(store, raw, tickers, settings)
    elif stage == "score":
        pipeline.score(store, limit=a.limit, settings=settings, batch=a.batch_size)
    elif stage == "features":
        pipeline.build_features(store, settings)
    elif stage == "analyse":
        for name, df in pipeline.analyse(store, settings).items():
            print(name)
            df.show(50, truncate=False)
    elif stage == "train":
        pipeline.train(store, settings, a.rounds).show(truncate=False)
    elif stage == "xs":
        M.cross_sectional_run(store.read("features"), a.test_start, rounds=a.rounds).show(truncate=False)
    elif stage == "monitor":
        for row in pipeline.monitor(store, a.model, settings):
            print(row)
    elif stage == "plots":
        ticker = a.ticker or store.read("features").groupBy("ticker").count().orderBy(F.desc("count"), "ticker").first()[0]
        figures.price_and_sentiment(store.read("prices"), store.read("features"), ticker, settings.start_date, settings.end_date).show()
    elif stage == "experiment":
        for df in pipeline.experiment(store, settings, a.rounds):
            df.show(truncate=False)
    elif stage == "serve":
        server(store, a.host, a.port, a.test_start, a.figures, a.reload).serve_forever()


def server(store: Store, host: str, port: int, test_start: str = SETTINGS.test_start, figures_folder: str = "reports", reload: bool = False):
    """A small HTTP server over the functions of ``service``, ready to serve.

    The model is the one that training stored as the best on all features; it is
    loaded at the first request that finds one, or at every one with ``reload``.
    """
    import json
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    held: dict = {}

    def bundle():
        if reload or "bundle" not in held:
            metrics = store.get_json("metrics")
            if metrics is None or metrics["combined"] is None:
                return None
            held["bundle"] = M.load_bundle(store.spark, f"{store.root}/models/combined")
        return held["bundle"]

    def name() -> str | None:
        return (bundle() or (None,))[0]

    def rows(df) -> list[dict]:
        return [r.asDict() for r in df.collect()]  # limited answers only

    def signal(q: dict) -> list[dict]:
        out = rows(service.signal(store.read("features"), store.read("prices"), q.get("ticker"), int(q.get("limit", 200))))
        if not out:
            raise service.NotFound("no rows")
        return out

    def trained() -> list[dict]:
        try:
            return service.metrics(store)["results"]
        except service.NotReady:
            return []

    window = lambda q: int(q.get("window", SETTINGS.monitor_window))
    routes = {
        "/health": lambda q: service.whole_health(store.read("headlines"), store.read("features"), name(), store.read("prices")),
        "/features/schema": lambda q: service.features_schema(name(), (bundle() or (None, []))[1]),
        "/signal": signal,
        "/predictions": lambda q: rows(service.newest_predictions(store.read("predictions"), q.get("model"), int(q.get("limit", 200)))),
        "/metrics": lambda q: service.metrics(store),
        "/monitor": lambda q: pipeline.monitor(store, q.get("model")),
        "/monitor/history": lambda q: rows(service.monitor_history(store.read("predictions"), q.get("model"), window(q))),
        "": lambda q: service.dashboard(store.spark, store.read("headlines"), store.read("features"), trained(), service.monitor_now(store.read("predictions"), store.read("features"))),
    }

    class Handler(BaseHTTPRequestHandler):
        def _send(self, body: object, code: int = 200) -> None:
            data = body if isinstance(body, bytes) else body.encode() if isinstance(body, str) else json.dumps(service.plain(body), allow_nan=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "image/png" if isinstance(body, bytes) else "text/html" if isinstance(body, str) else "application/json")
            self.end_headers()
            self.wfile.write(data)

        def _answer(self, work) -> None:
            try:
                self._send(work())
            except service.NotReady as e:
                self._send({"detail": str(e)}, 503)
            except service.NotFound as e:
                self._send({"detail": str(e)}, 404)
            except ValueError as e:
                self._send({"detail": str(e)}, 422)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            path = url.path.rstrip("/")
            if path.startswith("/figures/"):
                self._answer(lambda: _bytes(service.figure(figures_folder, path.removeprefix("/figures/"))))
            else:
                self._answer(lambda: routes.get(path, _unknown)(q))

        def do_POST(self) -> None:
            body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
            if urlparse(self.path).path.rstrip("/") == "/predict":
                self._answer(lambda: service.predict(bundle(), body.get("features", {})))
            else:
                self._send({"detail": "not found"}, 404)

    return HTTPServer((host, port), Handler)


def _unknown(q: dict) -> None:
    raise service.NotFound("no such path")


def _bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = prepare(SparkSession.builder.appName("quillpanel").getOrCreate())
    store = Store(spark, a.store)
    for stage in ORDER if a.stage == "all" else (a.stage,):
        run(stage, store, a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
