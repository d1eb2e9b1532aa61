"""What a worker process holds from one operator's tasks to another's."""

import pandas as pd

from framewright.llm import common, langid


def test_language_id_holds_no_other_operators_caches():
    common.kept(("encoder", "some path"), lambda: {"word": b"ids"})
    model = langid.HierarchicalModel(["some words here", "andere worte dort"], ["en", "de"])
    (got,) = langid.predicting(model)(iter([pd.Series(["words", None])]))
    assert got["lang"].tolist()[1] == "und" and not common._KEPT
