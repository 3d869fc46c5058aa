"""Files of images as DataFrames."""
