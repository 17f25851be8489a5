"""Each stage of the pipeline against what it must keep of its own input."""
import corpus_pipeline as cp
from slotwise.llm import decontam, jaccard, pii, quality
from slotwise.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, labels, bench = docs.columns, table(spark, SF, "labels"), table(spark, SF, "benchmark")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    kept = [docs]
    for _, stage in cp.STAGES[:-1]:
        kept.append(stored(stage(spark, kept[-1], SF), "t"))
        assert kept[-1].columns == columns
    assert ids(kept[1]) == ids(quality.score_quality(kept[0], labels).where("predicted = 1"))
    assert ids(kept[2]) == ids(jaccard.jaccard_components(kept[1]).where("doc_id = component_id"))
    assert ids(kept[3]) == ids(decontam.digest(decontam.scan(kept[2], bench)).where("NOT contaminated"))
    assert ids(kept[4]) == ids(kept[3])
    left = pii.digest(pii.find(kept[4])).selectExpr("sum(n_email + n_ip + n_card)").first()[0]
    assert left == 0
    packed = cp.run(spark, SF)
    assert ids(packed.dropDuplicates(["doc_id"])) == ids(kept[4])
