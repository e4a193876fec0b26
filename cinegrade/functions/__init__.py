"""Column expressions: text, weak labels, XML, web pages, stemming, title similarity."""
