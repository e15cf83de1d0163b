"""Places of one notice side by side, of which a later one matches better."""

from reviewlens.llm import license_scan


def test_worse_match_before_a_better_one():
    scanner = license_scan.Scanner(license_scan.NOTICES, license_scan.PHRASES)
    line = b" all rights reservd all rights reserved all rights reservd "
    spans = [(line[start:end].strip(), edits) for _, edits, start, end in scanner.fuzzy(line)]
    assert len(spans) == 3 and sorted(edits for _, edits in spans) == [0, 1, 1]
