from lectern.functions.names import content_disposition


def test_content_disposition():
    head = "inline; filename="
    assert content_disposition("A plain name.pdf") == head + "\"A plain name.pdf\"; filename*=UTF-8''A%20plain%20name.pdf"
    assert content_disposition("Müller: «x»/y_?.pdf") == head + "\"Muller_ x_y__.pdf\"; filename*=UTF-8''M%C3%BCller%3A%20%C2%ABx%C2%BB%2Fy_%3F.pdf"
    assert content_disposition("河流") == head + "\"download\"; filename*=UTF-8''%E6%B2%B3%E6%B5%81"
    assert content_disposition(None) == content_disposition("") == head + "\"download\"; filename*=UTF-8''"
    assert len(content_disposition("a" * 100_000)) > 200_000
