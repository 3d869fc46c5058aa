"""Views of tables as pixels, tiles, timelines and dimensions."""
