"""HTML parsing, editing and rendering of one document; runs inside Arrow batch functions."""
