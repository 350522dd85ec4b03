"""Line-up and play-log analytics on Spark DataFrames."""
