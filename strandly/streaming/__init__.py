"""Call sets as streams."""
