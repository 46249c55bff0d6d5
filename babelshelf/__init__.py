"""babelshelf: media-library cataloguing and spoken-language analytics on Spark DataFrames."""
