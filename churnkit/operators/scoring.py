"""Score whole snapshot tables with a trained bundle.

One lazy plan from the raw snapshot to probabilities: id, cleaning,
features, one-hot with the bundle's vocabulary, alignment to the bundle's
column list, scaling with the bundle's statistics, model.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from churnkit.operators.accounts import featurize_accounts
from churnkit.operators.clean import Scaler, Vocabulary, align_columns, apply_scaler, one_hot
from churnkit.operators.models import predict_proba
from churnkit.sources.accounts import ensure_id


def prepare_for_model(raw: DataFrame, vocab: Vocabulary, columns: list[str], scaler: Scaler | None,
                      id_col: str = "customerID", variant: str = "training") -> DataFrame:
    df = ensure_id(raw, id_col)
    feat = featurize_accounts(df, variant)
    enc = one_hot(feat, vocab)
    aligned = align_columns(enc, columns, keep=(id_col,))
    return apply_scaler(aligned, scaler) if scaler else aligned


def score(raw: DataFrame, model: PipelineModel, vocab: Vocabulary, columns: list[str],
          scaler: Scaler | None, id_col: str = "customerID", out: str = "churn_probability") -> DataFrame:
    """(id, model inputs..., probability) for every row of ``raw``."""
    prepared = prepare_for_model(raw, vocab, columns, scaler, id_col)
    return predict_proba(model, prepared, columns, out=out)
