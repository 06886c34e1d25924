"""No setting of the machine takes work off the registered models."""

import os
import subprocess
import sys

from propensa.operators import training
from propensa.plans import QUERIES


def test_no_setting_shrinks_the_line_up():
    """A tenth of the rounds and trees were trained where the environment asked for it."""
    code = (
        "from propensa.plans import modelling as m; t = m.training\n"
        "assert m._line_up() == t.LINE_UP and m._line_up(t.BALANCED_LINE_UP) == t.BALANCED_LINE_UP"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PROPENSA_ROUNDS_SHARE": "0.1"}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd=root)


def test_every_model_is_asked_for_whole(spark, sf_dir, monkeypatch):
    """Single models, forests and the round trip of a bundle had fewer trees, or two models of six."""
    asked = []

    class Done(Exception):
        pass

    def stop(*args, **given):
        asked.append(given)
        raise Done

    def compared(train, test, line_up, **given):
        asked.append(line_up)
        raise Done

    monkeypatch.setattr(training, "fit", stop)
    monkeypatch.setattr(training, "compare", compared)
    for name in ("random_forest", "boosted_regularized", "model_roundtrip"):
        try:
            QUERIES[name](spark, sf_dir)
        except Done:
            pass
    forest = training.LINE_UP["random_forest"]
    params = [{k: v for k, v in a.items() if k != "weight"} for a in asked]
    assert params == [forest, training.LINE_UP["boosted_regularized"], training.LINE_UP]

