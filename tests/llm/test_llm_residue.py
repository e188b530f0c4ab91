"""Residue patterns take linear time, and hold on wording that the lists weren't written from."""

from __future__ import annotations

import time

import pytest

from phenorank.llm import residue

RUNS = ["x", "xxx ", "x|", "a | ", "_b", "<a_b", "{", "{{", "{a ", "[", "[[a ", "<", "<<a", "<code>", "<pre ", "```", "~~~", "`", ". ", "..", "_", "__a ", "$", "$a ", "%", "%a ", "#a", "##", "@@a", "«a", "(", "TBD ", "foo", "test", "asdf ", "a, ",
        "error", "file \"", "at a.", "lorem ", "dd/", "xx/", "{% a", "<% a", "\n", "ui ", "placeholder {{a}} ", "|", "-", "​", "é"]


@pytest.mark.parametrize("run", RUNS)
def test_runs_take_linear_time(run):
    text = (run * 20_000)[:20_000]
    for body in (text + "y", text + "\ny", "<" + text, "{" + text, "[" + text + "\n", "a" + text + " z.\n" + text):
        began = time.process_time()
        residue.is_residue(body)
        assert time.process_time() - began < 1, body[:20]


def test_whole_of_long_lines():
    assert residue.only_residue("x" * 10_000) and residue.only_residue("xxxx " * 5_000) and not residue.only_residue("xxxx " * 5_000 + "y")
    assert residue.only_residue("Lorem ipsum dolor sit amet. " * 2_000) and not residue.only_residue("Lorem ipsum dolor sit amet. " * 2_000 + "The heart is normal.")


# written after the lists, from messages of common servers, browsers, frameworks and page builders
HELD_OUT = ["Error 1020: Access denied", "HTTP/1.1 503 Service Unavailable", "Not Found\nThe requested URL was not found on this server.", "Forbidden\nYou don't have permission to access this resource.", "An unexpected error occurred. Please try again later.",
            "Sorry, we couldn't find that page.", "This site can't be reached", "Your connection was interrupted", "Application error: a client-side exception has occurred", "We're having trouble loading this page. Please refresh.", "Request timed out.", "Database connection failed", "This page isn't working",
            "JavaScript is disabled in your browser. Please enable it and reload.", "JavaScript must be enabled to use this site.", "This application requires JavaScript.", "You have JavaScript turned off.", "Please turn on JavaScript in your browser settings.", "Trang này cần JavaScript để hoạt động.", "Lỗi máy chủ nội bộ",
            "Không tìm thấy trang", "Page introuvable", "Erreur 404 : page non trouvée", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Your text here", "Sample paragraph text.", "Click here to edit this text.", "test test test", "aaa aaa aaa aaa", "Under construction"]
REAL = ["The server was down during the scan, so images were stored locally.", "The error in gestational dating was corrected at 22 weeks.", "Access to the fetal heart was denied by position.", "Page 4 of the record describes the kidney.", "Loading dose was given before transfer.", "The template has a field for the spine.", "Test results: normal karyotype.",
        "The session ended after 40 minutes because the mother felt unwell.", "Không thấy bất thường tim thai.", "Erreur de mesure possible, contrôle dans deux semaines.", "JavaScript-based viewers were compared by three readers.", "No page of the booklet mentions cysts.", "Sample collected at 16 weeks.", "Heart normal.", "Text by hand: polyhydramnios.", "Construction of the growth curve used 300 fetuses."]


def test_held_out_wording():
    """At first measure 18 of 30 were found and 1 of 16 was wrong; the lists were left as they were."""
    found = sum(residue.is_residue(residue._even(t)) for t in HELD_OUT)
    wrong = sum(residue.is_residue(residue._even(t)) for t in REAL)
    assert found >= 18 and wrong <= 1
