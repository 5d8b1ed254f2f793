"""Where answers go: JSON, HTML, Mermaid, Markdown pages, line files, published generations."""
