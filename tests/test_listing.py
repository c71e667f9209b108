"""Listings of several saved pages: whole chains only."""

import pytest

from pressmill.sources import files


def page(folder, name, key, truncated, token=None, following=None):
    tag = lambda t, v: f"<{t}>{v}</{t}>" if v else ""
    (folder / name).write_text(f"<ListBucketResult>{tag('IsTruncated', truncated)}{tag('ContinuationToken', token)}{tag('NextContinuationToken', following)}<Contents><Key>{key}</Key><Size>3</Size></Contents></ListBucketResult>")


@pytest.fixture
def whole(tmp_path):
    page(tmp_path, "1.xml", "a", "true", None, "t1")
    page(tmp_path, "2.xml", "b", "true", "t1", "t2")
    page(tmp_path, "3.xml", "c", "false", "t2")
    return tmp_path


def test_whole_chain(spark, whole):
    assert sorted(r.Key for r in files.listing(spark, str(whole)).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("name", ["1.xml", "2.xml", "3.xml"])
def test_missing_page(spark, whole, name):
    (whole / name).unlink()
    with pytest.raises(ValueError, match="incomplete"):
        files.listing(spark, str(whole))


@pytest.mark.parametrize("change", [("4.xml", "d", "false", "t9"), ("4.xml", "d", "false", "t2"), ("3.xml", "c", "true", "t2"), ("3.xml", "c", None, "t2"), ("3.xml", "c", "true", "t2", "t1")])
def test_stray_repeated_and_unstated_pages(spark, whole, change):
    page(whole, *change)
    with pytest.raises(ValueError, match="listing"):
        files.listing(spark, str(whole))
