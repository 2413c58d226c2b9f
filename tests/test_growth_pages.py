"""A batch of pages isn't held as Python's texts."""

import pyarrow as pa

from quarry.documents import storage_format


def test_pages_of_a_batch_come_as_packed_text(spark, monkeypatch):
    taken = {}
    monkeypatch.setattr(storage_format.F, "arrow_udf", lambda each, kind: lambda pages: taken.update(each=each))
    storage_format.macros_to_html("page")
    texts = [None if i % 3 == 0 else f'<ac:structured-macro ac:name="tip"><ac:rich-text-body>{i}</ac:rich-text-body></ac:structured-macro>' for i in range(200)]
    out = taken["each"](pa.array(texts, pa.string()))
    assert [x["html"] for x in out.to_pylist()] == [None if i % 3 == 0 else f"<blockquote><p>💡 </p>{i}</blockquote>" for i in range(200)]
    assert len(taken["each"](pa.array([], pa.string()))) == 0
