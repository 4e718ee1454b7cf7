from tidewheel.cli import main

main()
