"""folium: a PySpark-native engine for hypertext documents, packages and text corpora."""
