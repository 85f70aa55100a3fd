"""Posteriors of sparse sites."""

from eventlens.llm import quality

GOOD = "The river rose in the night and the people of the town moved their boats to the higher bank before dawn number {0}."
BAD = "BUY NOW $$$ {0} ### CLICK | HERE | FREE | FREE | !!! >>> WIN {0}{0} <<< @@@"


def test_a_labelled_row_is_no_evidence_on_itself(spark):
    rows = [(i, (GOOD if i % 2 else BAD).format(i), f"s{i % 7 % 3}", "en") for i in range(80)]
    # labels against what the texts look like, each on a site of its own
    rows += [(100, BAD.format(100), "own1", "en"), (101, GOOD.format(101), "own2", "en"), (102, GOOD.format(102), "own3", "en")]
    labels = [(i, i % 2) for i in range(80)] + [(100, 1), (101, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.row.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert len(got) == len(rows)
    prior = got[102].p_host  # no label, nothing else on its site
    for i in (100, 101, 102):
        assert abs(got[i].p_host - prior) < 1e-9 and abs(got[i].p_path - prior) < 1e-9
        # alone on its site a document is as good as its text
        assert abs(got[i].p_good - got[i].p_text) < 1e-6
